"""URL templates, toxicity, and the pipeline against plain loops."""

import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linksift.llm import toxicity, url_templates
from linksift.llm.oracles import ORACLES
from linksift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
URL_SCHEMA = "page_id long, url string, html string, host int, verdict int"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return brute.ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def fitting(host, path):
    fit = [(len(h + p), v, h + p) for h, p, v in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def verdicts(urls):
    """url -> (host, path, rule, verdict), with the tree built by plain loops."""
    pages = [(u, *host_path(u)) for u in urls]
    ruled = {u: fitting(h, p) for u, h, p in pages}
    tree = defaultdict(lambda: [0, 0])
    for u, h, p in pages:
        shape = re.sub("[0-9]+", "#", p)
        cell = tree[(h, shape)]
        if ruled[u][0]:
            cell[0] += 1
            cell[1] += ruled[u][0] == "block"
    rows = {}
    for h, shape in tree:
        parts = shape.split("/")[1:]
        if len(parts) > url_templates.DEPTH:
            parts = parts[: url_templates.DEPTH - 1] + ["/".join(parts[url_templates.DEPTH - 1 :])]
        rows[(h, shape)] = [parts, "", ""]
    for at in range(url_templates.DEPTH):
        children = defaultdict(set)
        for (h, _), (parts, _, template) in rows.items():
            if at < len(parts):
                children[(h, template)].add(parts[at])
        for (h, _), row in rows.items():
            if at < len(row[0]):
                wide = len(children[(h, row[2])]) > url_templates.CHILDREN
                row[1], row[2] = row[2], row[2] + "/" + ("*" if wide else row[0][at])
    leaves = defaultdict(lambda: [0, 0])
    for key, (_, parent, template) in rows.items():
        for k in (0, 1):
            leaves[(key[0], parent, template)][k] += tree[key][k]
    n_all, bad_all = (sum(v[k] for v in leaves.values()) for k in (0, 1))
    rejected = set()
    for host in {h for h, _, _ in leaves}:
        own = {k: v for k, v in leaves.items() if k[0] == host}
        n, bad = (sum(v[k] for v in own.values()) for k in (0, 1))
        share = (bad + 20 * bad_all / max(n_all, 1)) / (n + 20)
        for parent in {k[1] for k in own}:
            branch, before = [], None
            groups = []
            for key, (a, b) in sorted(((k, v) for k, v in own.items() if k[1] == parent and v[0]), key=lambda e: (e[1][1] / e[1][0], e[0][2])):
                if before:
                    pooled = (b + before[1]) / (a + before[0])
                    spread = (pooled * (1 - pooled) * (1 / a + 1 / before[0])) ** 0.5
                    if spread > 0 and abs(b / a - before[1] / before[0]) > 1.96 * spread:
                        groups.append(branch)
                        branch = []
                branch.append((key, a, b))
                before = (a, b)
            for group in [*groups, branch]:
                total, hits = sum(g[1] for g in group), sum(g[2] for g in group)
                if group and (hits + 20 * share) / (total + 20) >= 0.9:
                    rejected |= {g[0] for g in group}
        if share >= 0.9:
            rejected |= {k for k, v in own.items() if not v[0]}
    out = {}
    for u, h, p in pages:
        shape = re.sub("[0-9]+", "#", p)
        _, parent, template = rows[(h, shape)]
        found = "block" if (h, parent, template) in rejected else "allow"
        out[u] = (h, p, ruled[u][1], ruled[u][0] or found)
    return out


ODD_URLS = [None, "", "no scheme/de/1", "http://", "https://A.Example.ORG/es/1", "x://example.org/en/12?q=/de/", "http://notexample.org/es/", "http://com/de/", "http://b.com", "http://b.com?x://y", "http://b.com/DE/1", "a://b://c.com/de/x", "http://org/", "http://u@h.com:80/fr/a#b"]
ODD_URLS += [f"http://bad.com/de/{i}" for i in range(300)] + [f"http://bad.com/en/{w}" for w in "abc"] + [f"http://half.com/{k}/{i}" for k in ("de", "fr", "en") for i in range(30)]
ODD_URLS += [f"http://wide.com/{'de' if i % 9 else 'fr'}/x{chr(97 + i % 26)}{chr(97 + i // 26)}/y" for i in range(200)] + ["http://deep.com/de/" + "/".join("abcdefghij")] * 3


def test_url_templates(spark):
    pages = spark.createDataFrame([(i, u, None, 1, 2) for i, u in enumerate(ODD_URLS)], URL_SCHEMA)
    rules = spark.createDataFrame(url_templates.RULES, "host string, path string, verdict string")
    got = url_templates.judge_urls(pages, rules).collect()
    want = verdicts(ODD_URLS)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: want[u] for i, u in enumerate(ODD_URLS)}
    assert any(r.rule is None and r.verdict == "block" for r in got)


def test_url_templates_of_the_pages(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op6_url_templates"](spark, SF).collect()}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = verdicts(list(urls.values()))
    assert got == {k: want[u] for k, u in urls.items()}


def test_url_templates_without_labels_of_their_own(spark):
    """They follow their nearest labelled branch, merged with its siblings, and their shape elsewhere."""
    rules = [("h.com", "/shop/bad/", "block"), ("h.com", "/ok/", "allow"), ("i.com", "/ok/", "allow"), ("com", "/de/", "block")]
    rules += [("i.com", f"/{k}/bad/", "block") for k in "abcdefghij"]
    urls = [f"http://h.com/{k}/{i}" for k in ("shop/bad", "ok") for i in range(300)] + [f"http://i.com/ok/{i}" for i in range(300)]
    urls += [f"http://i.com/{k}/bad/{i}" for k in "abcdefghij" for i in range(15)] + [f"http://n{chr(97 + i % 26)}.com/de/{i}" for i in range(300)]
    bare = {"http://h.com/shop/new": "block", "http://h.com/new": "allow", "http://i.com/a/new": "block", "http://x.net/de/7": "block", "http://x.net/fr/7": "allow"}
    pages = spark.createDataFrame([(i, u, None, 1, 2) for i, u in enumerate([*urls, *bare])], URL_SCHEMA)
    got = url_templates.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r.page_id: r.verdict for r in got.where("rule is null").collect()} == {len(urls) + i: v for i, v in enumerate(bare.values())}


def test_url_templates_without_pages_or_rules(spark):
    rules = spark.createDataFrame(url_templates.RULES, "host string, path string, verdict string")
    assert url_templates.judge_urls(spark.createDataFrame([], URL_SCHEMA), rules).count() == 0
    pages = spark.createDataFrame([(None, "http://a.com/de/1", None, 1, 2)] * 2, URL_SCHEMA)
    assert [tuple(r) for r in url_templates.judge_urls(pages, rules.limit(0)).collect()] == [(None, "a.com", "/de/1", None, "allow")] * 2


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # the smaller ones have too few labelled rows to learn from
    scored = QUERIES["op8_toxicity"](spark, sf).cache()
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [k for k in labels if rows[k].held_out]
    right = sum(rows[k].predicted == labels[k] for k in held) / len(held)
    assert right > 0.93


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1), (99999, 0)], "doc_id long, toxic int")
    model = toxicity.fit_model(odd_docs, labels)
    scored = toxicity.score_documents(odd_docs, model, list(odd_docs.columns)).collect()
    assert Counter(r.row.text for r in scored) == Counter(r.text for r in odd_docs.collect())
    by_text = {}
    for r in scored:  # equal texts, whatever the row, score alike; none and no words alike too
        assert 0 <= r.score <= 1 and by_text.setdefault(r.row.text, r.score) == r.score
    assert by_text[None] == by_text[""] == by_text[" \t\n"]
    none = toxicity.fit_model(no_docs, labels.limit(0))
    assert toxicity.score_documents(odd_docs, none, ["doc_id"]).where("score = 0.5").count() == odd_docs.count()
    assert toxicity.score_documents(no_docs, none, ["doc_id"]).count() == 0


def test_toxicity_fits_on_as_many_texts_as_labels(spark):
    """One id holds most rows: one of its texts is learned from, the same for any order."""
    rows = [(1, f"text {i}") for i in range(600)] + [(1, "text 5")] * 300 + [(2, "other")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = [toxicity.fit_model(d, labels) for d in (docs.repartition(1), docs.repartition(5), docs.distinct())]
    assert seen[0] == seen[1] == seen[2]


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """More labels than one part takes: all are read, and the model is the same for any order."""
    texts = [f"{'some vile' if i % 3 else 'a kind'} word{i % 7} here in text {i}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(700)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    fitted, read = toxicity._fitted, []

    def seen(over, parts, shared):
        read.append((int(over(toxicity._sizes)[0][0]), parts))
        return fitted(over, parts, shared)

    monkeypatch.setattr(toxicity, "_fitted", seen)
    models = [toxicity.fit_model(d, labels) for d in (docs.repartition(3), docs.orderBy(-docs.doc_id))]
    assert read == [(700, 7)] * 2 and models[0] == models[1]
    scores = {r.row.doc_id: r.score for r in toxicity.score_documents(docs, models[0], ["doc_id"]).collect()}
    assert all((scores[i] >= toxicity.CUT) == (i % 3 > 0) for i in scores)


def plain_score(model, text):
    """One word, filter and place after another, then the cut-off of the text's language."""
    rows = toxicity.Words()(text).tolist() or [[2 * toxicity.BUCKETS] * 2]
    vectors = [model.embed[a].astype(float) + model.embed[b] for a, b in rows] + [np.zeros(toxicity.DEPTH)] * 2
    total = model.base
    for number, weights in enumerate(model.filters):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(vectors[at + k] @ weights[k][:, f]) for k in range(len(weights))) for at in range(len(rows)))
            unit = number * toxicity.FILTERS + f
            total += max(best + model.bias[unit], 0) * model.out[unit]
    counts = {k: sum(toxicity.WORD.findall((text or "").lower()).count(w) for w in ws) for k, ws in toxicity.FUNCTION_WORDS.items()}
    most = [k for k, n in counts.items() if n and n == max(counts.values())]
    spoken = most[0] if len(most) == 1 else "other"
    z = total - model.shift.get(spoken, 0.0) + np.log(0.7 / 0.3)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_against_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stored = toxicity.fit_model(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + [None, "", "the and der die", "?"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.loaded(stored)
    assert model.shift
    got = {r.row.doc_id: r.score for r in toxicity.score_documents(frame, stored, ["doc_id"]).collect()}
    assert got == pytest.approx({i: plain_score(model, text) for i, text in enumerate(texts)}, abs=1e-4)


def test_long_texts_are_scored_whole(monkeypatch):
    texts = [f"fine word{i} here" for i in range(40)] + [f"some idiot{i} here" for i in range(40)]
    model = toxicity.fit(texts, [0] * 40 + [1] * 40)
    assert toxicity.loaded(toxicity.stored(model)).shift == model.shift
    words = toxicity.Words()
    long = [words("fine here " * 500 + "some idiot5 here " + "fine here " * 700), words("fine here " * 900), words("")]
    whole = toxicity.logits(model, long)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 50)
    assert abs(toxicity.logits(model, long) - whole).max() < 1e-4
    assert whole[0] > whole[1]


def plain_pipeline(rows, items):
    """Which documents each stage leaves, and their texts."""
    left = [(k, t) for k, t in rows if brute.quality(t)[-1]]
    yield dict(left)
    left = list(brute.similar_lines(left).items())
    yield dict(left)
    groups = brute.near_duplicates(left, 5)
    left = [(k, t) for k, t in left if groups[k][1] == k]
    yield dict(left)
    yield {k: t for k, t in left if not brute.contamination(t, items)[3]}


def test_pipeline_stages(spark, docs, pairs, tmp_path):
    parts = [" ".join((t or "").split()[:60]) for _, t in pairs[2:5]]
    benchmark = spark.createDataFrame(list(enumerate(parts)), "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_pipeline(pairs, list(enumerate(parts)))):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        rows = now.collect()
        assert {r.doc_id: r.text for r in rows} == want, name
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
        sizes.append(len(rows))
    assert sizes[0] < len(pairs) and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_near_dedup_stage_takes_five_words(spark):
    """One word in 40 changed: similar by sets of four words, not by sets of five."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join("new" if i % 40 == 20 else w for i, w in enumerate(words))), (3, " ".join(words) + " end")]
    like = [[len(a & b) / len(a | b) for b in sets[1:]] for n in (4, 5) for sets in [[brute.shingles(t, n) for _, t in rows]] for a in sets[:1]]
    assert like[0][0] >= 0.8 > like[1][0] and like[1][1] >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_removal(spark, docs, "").collect()) == [1, 2]


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    odd_docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    no_docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
