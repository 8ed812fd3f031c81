"""Quality rules, decontamination, near duplicates, lines and repeated spans against plain loops."""

import hashlib
import random
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from linksift.llm import decontaminate, line_dedup, near_dedup, quality, suffix_dedup

ITEMS = [(1, None), (2, "..."), (None, "an item without id"), (3, "one"), (3, "one")]


def test_quality_rules(odd_docs, odd_rows):
    got = quality.quality_verdicts(odd_docs, odd_docs.columns, quality.MEASURES).collect()
    assert all(r.row.kept in ("no", None) and r.row.n_words in (1, None) for r in got)
    have = Counter((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert have == Counter((r[0], *brute.quality(r[1])) for r in odd_rows)


def test_rules_are_ordered_by_rejections_per_cost(spark):
    texts = ["# # # " * 40] * 30 + ["fine words " * 40] * 10
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    costly = quality.Rule("costly", lambda m: m.n_repeat_words > 0 and m.n_symbols > 0)
    never = quality.Rule("never", lambda m: False)
    cheap = quality.Rule("cheap", lambda m: m.n_symbols > 0)
    order = [r.name for r in quality.order_rules(docs, (never, costly, cheap))]
    assert order == ["cheap", "costly", "never"]


def test_cascade_stops_at_the_first_rejection(spark):
    def fails(m):
        raise ValueError

    docs = spark.createDataFrame([(1, "# " * 60 + " ".join(map(str, range(60))))], "doc_id int, text string")
    rules = [quality.Rule("symbols", lambda m: m.n_symbols > 5), quality.Rule("fails", fails)]
    assert quality.judge(docs, rules, ["doc_id"]).first().rejected_by == "symbols"


def items_for(pairs):
    parts = [" ".join((t or "").split()[5:40]) for _, t in pairs[10:14]]
    return ITEMS + [(i + 10, p) for i, p in enumerate(parts)] + [(30, parts[0]), (31, " ".join((pairs[20][1] or "").split()[:7]))]


@pytest.mark.parametrize("broadcast", [1_000, 0])
def test_decontamination(spark, odd_docs, odd_rows, pairs, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items = items_for(pairs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(odd_docs, benchmark, ["doc_id", "n_words"])
    have = Counter((r.row.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got.collect())
    want = Counter()
    for row in odd_rows:
        n, hit, ids, bad = brute.contamination(row[1], items)
        want[(row[0], n, hit, tuple(i for i in ids if i != "None"), bad)] += 1
    assert have == want and any(k[4] for k in want)


def test_near_duplicates(docs, pairs):
    want = brute.near_duplicates(pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    assert sum(c != k for k, (_, c) in want.items()) > 30


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows):
    got = near_dedup.near_duplicates(odd_docs).collect()
    groups, ids = brute.near_duplicates([(i, r[1]) for i, r in enumerate(odd_rows)]), {}
    for i, r in enumerate(odd_rows):
        n, root = groups[i]
        if n and r[0] is not None:
            ids[root] = min(r[0], ids.get(root, r[0]))
    want = [(r[0], groups[i][0], ids.get(groups[i][1]) if groups[i][0] else r[0]) for i, r in enumerate(odd_rows)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((k, n, c, c is None or k == c) for k, n, c in want)
    kept = near_dedup.without_near_duplicates(odd_docs, odd_docs.columns)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()


def test_one_document_of_each_component_stays(spark):
    """Components without ids, and rows equal in id and text, leave one row; rows without words stay."""
    texts = [" ".join(f"{name}{i}" for i in range(200)) for name in "abcd"]
    rows = [(None, texts[0], 1), (None, texts[0], 2), (None, texts[0] + " end", 3), (7, texts[1], 4), (7, texts[1], 4), (7, texts[1], 4)]
    rows += [(None, texts[2], 5), (9, texts[2] + " end", 6), (9, texts[2] + " end", 7), (8, texts[2] + " stop", 8), (8, texts[3], 9)]
    rows += [(None, "", 10), (None, "", 11), (20, " ", 12), (21, " ", 13), (21, " ", 13), (None, None, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    got = near_dedup.without_near_duplicates(docs, ["doc_id", "n"])
    kept = sorted(r.n for r in got.collect())
    assert len([n for n in kept if n <= 3]) == 1
    assert [n for n in kept if n > 3] == [4, 8, 9, 10, 11, 12, 13, 14]


def test_a_large_group_that_drifts_apart(spark):
    """Copies of copies, each with a few words changed: many are like some others, few like all."""
    rng = random.Random(9)
    texts = [[f"w{i}" for i in range(60)]]
    for key in range(700):
        words = list(texts[rng.randrange(max(0, len(texts) - 40), len(texts))])
        words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: c for k, (_, c) in brute.near_duplicates(rows).items()}


def test_near_duplicates_without_a_common_centre(spark):
    """A chain of texts, each close to the next: one component, found in several rounds."""
    words = [f"w{i}" for i in range(300)]
    rows = [(100 - i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(20)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: c for k, (_, c) in brute.near_duplicates(rows).items()}


def test_sketches_fill_and_estimate():
    hashes = near_dedup.ShingleHashes(4)
    one = hashes("a b c d")
    assert len(one) == 1 and len(hashes("A b\tc d a b c d")) == 4 and len(hashes(" ")) == 0
    assert near_dedup.sketch(one).max() < 1 << 62
    x = hashes(" ".join(f"w{i}" for i in range(1000)))
    y = hashes(" ".join(f"w{i}" for i in range(200, 1200)))
    same = (near_dedup.sketch(x) == near_dedup.sketch(y)).mean()
    assert abs(same - 797 / 1197) < 0.15


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_similar_lines(docs, pairs, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    want = brute.similar_lines(pairs)
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs, ["doc_id"]).collect()}
    assert got == want
    assert sum(want[k] != t for k, t in pairs) > 30


@pytest.mark.parametrize("hot,frequent", [(3, (64, 64)), (0, (2, 16)), (100_000, (1, 1))])
def test_similar_lines_whatever_counts_as_frequent(docs, pairs, monkeypatch, hot, frequent):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "LONG", 12)
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs, ["doc_id"]).collect()}
    assert got == brute.similar_lines(pairs)


def test_similar_lines_where_many_drift_apart(spark):
    """Lines that follow one another in steps: similar to some earlier line, not to the first."""
    rng = random.Random(6)
    line, rows = [f"w{i}" for i in range(20)], []
    for key in range(150):
        line = line[1:] + [f"w{20 + key}"] if key % 3 else [*line[:19], f"v{rng.randrange(9)}"]
        rows.append((key, " ".join(line) + "\nthe same line for a third of all"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs, ["doc_id"]).collect()}
    assert got == brute.similar_lines(rows)


def test_similar_lines_of_odd_rows(odd_docs, odd_rows):
    """Equal rows are one document; of rows that share an id the lines go by number, then by hash."""
    got = line_dedup.dedup_lines(odd_docs, list(odd_docs.columns)).collect()
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert Counter(r.row.text for r in got) == Counter(r[1] for r in odd_rows)
    plain = {k: (None if t is None else t.split("\n")) for k, t, *_ in odd_rows if k is not None and k not in (2, 4)}
    nothing = {None: (None, 0, 0), "": ("", 1, 0), " \t\n": (" \t\n", 2, 0)}
    for r in got:
        if r.row.text in nothing:
            assert (r.text, r.n_lines, r.n_removed) == nothing[r.row.text]
        if r.row.doc_id in plain and r.row.text is not None:
            kept = iter(plain[r.row.doc_id])
            assert all(line in kept for line in r.text.split("\n")) or r.n_removed == r.n_lines
    # The rows without an id come first, so row 1, whose text one of them has, loses every line with a word.
    assert all(not brute.WORD.search(line) for line in next(r for r in got if r.row.doc_id == 1).text.split("\n"))


def test_short_lines_go_too(spark):
    """Lines of one word or more, also of many words but few different ones; lines without words stay."""
    rows = [(1, "menu\n\nlog in now\none two three four\n" + "la le li lo " * 15), (2, "Menu\n\nnow log in\nlog in\none two three four five")]
    rows += [(3, "menu\n \n" + "la le li lo " * 15 + "\nother")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs, ["doc_id"]).collect()}
    assert got == {1: rows[0][1], 2: "\nlog in", 3: " \nother"}


def test_words_are_sent_only_to_pairs_that_may_be_similar(spark):
    """All similar pairs and few others are left to be compared word by word; places may hold two sets."""
    rng = random.Random(8)
    sets = [rng.sample(range(4_000), rng.randint(1, 120)) for _ in range(60)]
    sets += [sorted({*rng.sample(s, len(s) * 9 // 10), *rng.sample(range(4_000), len(s) // 12)}) for s in sets]
    rows = [(i if i < 118 else 118, i % 2 if i < 118 else 0, [f"w{x}" for x in s]) for i, s in enumerate(sets)]
    every = [(*x[:2], *y[:2]) for x in rows for y in rows if x[0] > y[0]]
    found = line_dedup._near(
        spark.createDataFrame(every, "doc_x long, no_x long, doc_y long, no_y long"),
        spark.createDataFrame(rows, "doc long, no long, words array<string>"),
    )
    got = [tuple(r) for r in found.collect()]
    similar = {(*x[:2], *y[:2]) for x in rows for y in rows if x[0] > y[0] and 5 * len({*x[2]} & {*y[2]}) >= 4 * len({*x[2]} | {*y[2]})}
    assert len(got) == len(set(got)) and similar <= set(got) <= set(every)
    assert len(similar) > 30 and len(got) < 2 * len(similar)


def test_repeated_spans(docs, pairs):
    want = brute.repeated_spans(pairs)
    got = suffix_dedup.without_repeats(docs, ["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_spans_in_large_buckets(docs, pairs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", 2)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    got = suffix_dedup.without_repeats(docs, ["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated_spans(pairs)


def test_repeated_spans_in_small_slices(docs, pairs, monkeypatch):
    """Workers take and give few rows at a time, on either way of counting strings."""
    monkeypatch.setattr(suffix_dedup, "SLICE_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", 3)
    got = suffix_dedup.without_repeats(docs, ["doc_id"]).collect()
    assert {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated_spans(pairs)


def test_names_of_prefixes_take_little_memory():
    text = np.random.default_rng(9).integers(0, 2, 60_000).astype(np.uint8)
    text[20_000:40_000] = text[:20_000]
    places = np.arange(len(text) - suffix_dedup.PERIOD)
    tracemalloc.start()
    names = suffix_dedup.prefix_names(text, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    prefixes = [text[p : p + suffix_dedup.PERIOD].tobytes() for p in places]
    rank = {x: n for n, x in enumerate(sorted(set(prefixes)))}
    assert names.tolist() == [rank[x] for x in prefixes]
    assert peak < 100 * len(places)


def test_repeated_spans_of_odd_rows(odd_docs, odd_rows):
    got = suffix_dedup.without_repeats(odd_docs, ["doc_id", "size"]).collect()
    plain = brute.repeated_spans([(i, r[1]) for i, r in enumerate(odd_rows)])
    want = Counter((r[0], *plain[i]) for i, r in enumerate(odd_rows))
    assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_anchors_across_chunks(monkeypatch):
    data = bytes((i * i * 31 + i // 7) % 251 for i in range(9_000))
    whole = suffix_dedup.Anchors().runs(data)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000)
    starts = lambda runs: {s + k: p for s, n, p in runs for k in range(n)}
    assert starts(suffix_dedup.Anchors().runs(data)) == starts(whole)
    assert set(starts(whole)) == set(range(9_000 - 399))


def test_cover_is_a_difference_cover():
    found = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert found == set(range(suffix_dedup.PERIOD))


def test_empty_tables(spark, no_docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality_verdicts(no_docs, ["doc_id"]).count() == 0
    assert decontaminate.contamination(no_docs, benchmark, ["doc_id"]).count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs, ["doc_id"]).count() == 0
    assert suffix_dedup.without_repeats(no_docs, ["doc_id"]).count() == 0


def test_empty_benchmark(spark, docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark, ["doc_id"])
    assert found.where("n_hit > 0 or contaminated or n_items > 0").count() == 0 and found.count() == docs.count()
    assert found.where(F.size("item_ids") > 0).count() == 0
