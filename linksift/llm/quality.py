"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample.

A document without text, or without a word, has zero in every measure. A rule rejects or passes;
the verdict is the same in any order, since a document is kept if no rule rejects it. Rules that tie
keep the order of their names. Repeated rows are judged alike, texts of any length whole; an empty table
gives no rows. Carried columns travel in the struct ``row``, so that no names clash.
"""

from __future__ import annotations

import re
import string
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SAMPLE_ROWS = 2_000
SAMPLE_FILES = 16


class Measured:
    """The measures of one text, each worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of three words that the text has at least twice."""
        if self.n_words < 4:
            return 0
        seen: dict[str, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 1 << 20:  # three numbers would not fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(seen) + ids[2:]
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[which] > 1
        covered = np.zeros(len(ids), bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def utf8(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def n_upper(self) -> int:
        return len(self.utf8) - len(self.utf8.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.utf8) - len(self.utf8.translate(None, LOWER))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
#: Junk that running text does not show: a symbol on every tenth word, mostly capitals, half of
#: the lines again, or "words" of more than 20 characters on average.
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("capitals", lambda m: m.n_upper > m.n_lower and m.n_upper > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("long_words", lambda m: m.word_chars > 20 * m.n_words),
)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """At most ``rows`` texts out of ``files`` evenly spaced files, so that no full scan is needed.

    Serves to order rules only; a table that is not read from files is sampled as a whole.
    """
    names = sorted(docs.inputFiles())
    texts = docs.select("text")
    if len(names) > files:
        chosen = names[:: len(names) // files][:files]
        texts = docs.sparkSession.read.schema(texts.schema).parquet(*chosen)
    return texts.orderBy(F.xxhash64("text")).limit(rows)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected share per second of work on a sample, best first; ties by name.

    Each rule is timed on measures of its own, so shared work is charged to each that needs it.
    An empty sample leaves the rules as given.
    """

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, rule in enumerate(rules):
                began = time.thread_time()
                hits = sum(rule.rejects(Measured(text)) for text in texts)
                cost = time.thread_time() - began
                yield pa.RecordBatch.from_pydict({"rule": [at], "hits": [hits], "cost": [cost]}, schema=trials)

    trials = pa.schema([("rule", pa.int32()), ("hits", pa.int64()), ("cost", pa.float64())])
    found = (
        sample(docs, rows)
        .mapInArrow(trial, "rule int, hits long, cost double")
        .groupBy("rule")
        .agg(F.sum("hits").alias("hits"), F.sum("cost").alias("cost"))
        .collect()
    )
    worth = {row["rule"]: row["hits"] / max(row["cost"], 1e-9) for row in found}
    order = sorted(range(len(rules)), key=lambda at: (-worth.get(at, 0.0), rules[at].name))
    return [rules[at] for at in order]


def judge(
    docs: DataFrame, cascade: list[Rule], columns: list[str], measures: tuple[str, ...] = ()
) -> DataFrame:
    """row (the carried ``columns``) with ``base_failed``, ``rejected_by`` and ``kept``.

    The base rules come first; a document that fails none of them goes through the cascade until
    a rule rejects it. ``rejected_by`` names the rule (null for kept documents). Measures asked
    for in ``measures`` are added for every document, else only what the rules need is worked out.
    """
    source = docs.select("text", F.struct(*columns).alias("row"))
    added = [(m, "long") for m in measures]
    added += [("base_failed", "boolean"), ("rejected_by", "string"), ("kept", "boolean")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = [f"row {source.schema['row'].dataType.simpleString()}", *(f"{name} {kind}" for name, kind in added)]

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                m = Measured(text)
                base = next((r.name for r in BASE_RULES if r.rejects(m)), None)
                by = base or next((r.name for r in cascade if r.rejects(m)), None)
                rows.append((*(getattr(m, name) for name in measures), base is not None, by, by is None))
            found = list(zip(*rows)) or [()] * len(added)
            arrays = [batch.column("row"), *(pa.array(x, kinds[kind]) for x, (_, kind) in zip(found, added))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", *(name for name, _ in added)])

    return source.mapInArrow(verdicts, ", ".join(schema))


def quality_verdicts(
    docs: DataFrame, columns: list[str], measures: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Order the rules on a sample of ``docs`` and judge every document."""
    return judge(docs, order_rules(docs, rules), columns, measures)
