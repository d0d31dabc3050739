"""Reading questions (survey T8, T9): what the gate looks for, read off a question's words.

A question is cut, leftmost and longest, into words of closed lists (particles, the topic mark,
others) and runs of content between them. The slot is the first run that begins with a question
word; the particle behind it says which arm of a sentence the answer must stand on. A slot without
one is asked by its predicate: "Y is what". The rest is read from the runs and what follows each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from factspan.operators.gate import IGNORE, Reading

QUESTION = (
    "qid long, form string, subject array<string>, seek string, level string, chain array<string>, unread array<string>, kind_only boolean, "
    "particle string, noun string, head string, y string, y_forms array<string>, echo array<string>"
)


@dataclass(frozen=True)
class Grammar:
    """Closed word lists: those of the reading, question words, the subject's particle, the case
    particles in the order they are tried. Without spaces, words are found within runs of letters."""

    reading: Reading
    asking: tuple[str, ...]
    subject: str
    cases: tuple[str, ...]
    spaced: bool = True

    def pattern(self) -> re.Pattern:
        closed = "|".join(re.escape(w) for w in sorted({*self.reading.functions, *self.asking}, key=lambda w: (-len(w), w)))
        letter = r"[^\W_]"
        if self.spaced:
            return re.compile(rf"(?P<closed>(?<!{letter})(?:{closed})(?!{letter}))|(?P<content>{letter}+)", re.IGNORECASE)
        return re.compile(rf"(?P<closed>{closed})|(?P<content>(?:(?!{closed}){letter})+)")


@dataclass
class Run:
    """Content words that only ignorable characters part, and the closed words behind them."""

    words: list[str]
    start: int
    end: int
    after: list[str]
    direct: bool  # is nothing but closed words between it and the next run?

    @property
    def text(self) -> str:
        return "".join(self.words)

    @property
    def particle(self) -> str | None:
        return self.after[0] if self.after else None


def runs(text: str, grammar: Grammar) -> list[Run]:
    out: list[Run] = []
    asking, end = {w.lower() for w in grammar.asking}, 0
    for m in grammar.pattern().finditer(text):
        word, low = m.group(), m.group().lower()
        between = text[end : m.start()].strip(IGNORE + " ")
        if m.lastgroup == "closed" and low not in asking:
            if out:
                out[-1].after.append(low)
                out[-1].direct &= not between
        elif out and not out[-1].after and not between and low not in asking and out[-1].words[0].lower() not in asking:
            out[-1].words.append(word)
            out[-1].end = m.end()
        else:
            if out:
                out[-1].direct &= not between
            out.append(Run([word], m.start(), m.end(), [], True))
        end = m.end()
    return out


def read(text: str, grammar: Grammar) -> dict:
    """The columns of QUESTION but qid."""
    reading, found = grammar.reading, runs(text, grammar)
    asking = {w.lower() for w in grammar.asking}
    at = next((k for k, r in enumerate(found) if r.words[0].lower() in asking), None)
    slot = None if at is None else found[at]
    particle, noun, last = (slot.particle if slot else None), None, at
    if slot and particle == reading.genitive and at + 1 < len(found) and slot.direct and found[at + 1].particle not in (None, reading.genitive):
        # "whose N is": the slot is about a noun, and the noun's particle counts
        last, noun, particle = at + 1, found[at + 1].text, found[at + 1].particle
    arm = particle is not None and particle in reading.particles and particle != reading.topic
    before = found[at - 1] if at else None
    y = before if slot and not arm and before and before.particle == reading.topic else None
    form = "slot" if slot and arm else "predicate" if y else "open"

    taken = {at, last, at - 1 if y else None}
    free = [(k, r) for k, r in enumerate(found) if k not in taken]
    chain: list[Run] = []
    if form == "predicate":
        k = at - 2
        while k >= 0 and found[k].direct and found[k].after == [reading.genitive]:
            chain.append(found[k])
            k -= 1
    subject, level = ([chain[-1]], "chain") if chain else ([], None)
    for name, marks in (("topic", (reading.topic,)), ("subject", (grammar.subject,)), ("case", grammar.cases)):
        if not subject:
            subject = [r for _, r in free if r.particle in marks]
            level = name if subject else None
    head = None
    if form == "slot" and last + 1 < len(found) and found[last].direct:
        head = found[last + 1].words[0]
    y_forms = sorted({"".join(y.words[k:]) for k in range(len(y.words))}, key=lambda s: (-len(s), s)) if y else []
    y_forms = [s for s in y_forms if len(s) >= 2]
    units = [w for r in found for w in r.words if w.lower() not in asking]
    echo = list(dict.fromkeys([*units, *(r.text for r in subject), *y_forms]))
    return {
        "form": form, "subject": [r.text for r in subject], "seek": subject[0].words[0] if subject else None, "level": level, "chain": [r.text for r in reversed(chain)],
        "unread": [], "kind_only": False, "particle": particle if arm else None, "noun": noun, "head": head, "y": y.text if y else None, "y_forms": y_forms, "echo": echo,
    }


def read_questions(questions: DataFrame, grammar: Grammar) -> DataFrame:
    """QUESTION rows of questions(qid, text); a null text is an open question about nothing."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"qid": q, **read(t or "", grammar)} for q, t in zip(b["qid"], b["text"])], columns=[c.split()[0] for c in QUESTION.split(", ")])

    return questions.select("qid", "text").mapInPandas(step, QUESTION)
