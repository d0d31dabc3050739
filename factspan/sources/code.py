"""Code files as units (survey S16, X11, V6): Python tokens and definitions."""

from __future__ import annotations

import ast
import io
import tokenize

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENS = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("defines", T.BooleanType())])


def tokens_of(text: str) -> list[tuple[int, int, str, bool]]:
    """(line, position in the line, token, defines a name); a file that does not parse has none."""
    try:
        names = {(n.lineno, n.name) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        found = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.string.strip() and t.type not in (tokenize.COMMENT, tokenize.ENCODING)]
    except (SyntaxError, tokenize.TokenError, ValueError):
        return []
    out, count = [], {}
    for t in found:
        line = t.start[0]
        count[line] = count.get(line, -1) + 1
        out.append((line, count[line], t.string, (line, t.string) in names))
    return out


def code_units(files: DataFrame) -> DataFrame:
    """(path, text) to tokens; look-ups are those of any other tier."""
    import pyarrow as pa

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(TOKENS)
        for b in batches:
            rows = [(p, *t) for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in tokens_of(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, TOKENS)
