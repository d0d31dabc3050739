"""The pipeline against a brute-force version of every stage, and on odd tables."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from factspan.llm import langid, packing, pii
from tests.llm.test_corpus_operators import plain_classes, plain_hits
from tests.llm.test_span_operators import plain_pii

DIR = "/root/testdata/sf0.001"
EXTRA = [
    (5000, None, None, "x"), (5001, "", "en", "x"), (5002, "12 34", "en", None), (5003, "Mail me at some.one@mail.example.com or +1 (222) 555-1234 please, the and of it is that", "en", "x"),
    (5004, "Mail me at some.one@mail.example.com or +1 (222) 555-1234 please, the and of it is that", "en", "x"), (5005, "e " * 6000 + "end", "en", "x"),
]


def source(spark, tmp_path):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    item = bench.orderBy("item_id").first().text
    rows = [*EXTRA, (5006, f"{item} and more words after it", "en", "x")]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    more = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], docs.schema)
    docs.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_and_run(spark, tmp_path):
    d = source(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5

    score = langid.Scorer(langid.fit(docs))
    kept = {i: r.text for i, r in rows.items() for lang, sure in score([r.text]) if lang != "und" and sure >= 0.5}
    got = corpus_pipeline.identify_language(spark, docs, d)
    assert got.columns == columns and {r.doc_id: r.text for r in got.collect()} == kept
    assert not {5000, 5001, 5002} & set(kept)

    docs = docs.where(docs.doc_id.isin(list(kept)))
    first = {i for i, _, c in plain_classes(list(kept.items())) if i == c}
    got = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    assert got.columns == columns and sorted(r.doc_id for r in got.collect()) == sorted(first) and 5004 not in first

    docs = docs.where(docs.doc_id.isin(list(first)))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {h[0] for h in plain_hits([(i, kept[i]) for i in first], items) if not h[-1]}
    got = corpus_pipeline.drop_contaminated(spark, docs, d)
    assert got.columns == columns and {r.doc_id for r in got.collect()} == clean and 5006 not in clean

    docs = docs.where(docs.doc_id.isin(list(clean)))
    got = corpus_pipeline.mask_personal_data(spark, docs, d)
    masked = {r.doc_id: r.text for r in got.collect()}
    assert got.columns == columns and set(masked) == clean and all(r.n_chars == len(r.text) for r in got.collect())
    assert "<EMAIL>" in masked[5003] and "<PHONE>" in masked[5003] and not any(plain_pii(t) for t in masked.values())
    assert all(masked[i] == kept[i] for i in clean if not pii.base_spans(kept[i]))

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in masked.items():
        ids = plain.encode(t, add_special_tokens=False).ids + [1]
        want += [(i, k, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[lo : lo + 4096]))) for k, lo in enumerate(range(0, len(ids), 4096))]
    out = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in out) == sorted(want)
    bins = defaultdict(int)
    for r in out:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096


def test_run_on_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60").selectExpr("*", "'x' as node", "1L as row", "'y' as words", "0 as component_id", "array(1) as text_")
    odd = docs.limit(3).unionByName(docs.limit(1).selectExpr("null as doc_id", *(c for c in docs.columns if c != "doc_id")))
    long = docs.limit(1).withColumns({"doc_id": F.lit(900).cast("long"), "text": F.repeat(F.lit("the end of it and that is the long of the day in which "), 20_000)})
    docs.unionByName(odd).unionByName(long).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    table = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, d)
        assert table.columns == docs.columns
    out = corpus_pipeline.run(spark, d).collect()
    pieces = {(r.doc_id, r.piece) for r in out}
    # a repeated id comes through once; a row without an id is in no class and stays
    assert len([r for r in out if r.doc_id is not None]) == len([p for p in pieces if p[0] is not None])
    assert sum(p[0] == 900 for p in pieces) > 50 and any(p[0] is None for p in pieces)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
