"""The same results in plain SQL over the given tables.

The word lists, fixed values of the vocabulary, are shared with the jobs; tests hold them against
stated sizes and rows.
"""

from __future__ import annotations

from linksift.functions import vocabulary as V
from linksift.operators import learners as L
from linksift.plans.inputs import SCORED_MODELS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _pick(values: list[str] | str, number: str, size: int | None = None) -> str:
    size = size or len(values)
    values = values if isinstance(values, str) else _list(values)
    return f"({values})[({number} % {size}) + 1]"


def _draws(digests: int) -> str:
    return ", ".join(
        f"('0x' || substr(h{i}, {8 * s + 1}, 8))::BIGINT AS d{4 * i + s}"
        for i in range(digests)
        for s in range(4)
    )


def _digests(tag: str, key: str, digests: int) -> str:
    return ", ".join(f"md5('42:{tag}{i}:' || {key}) AS h{i}" for i in range(digests))


# 32-bit draws below these bounds count as a hit.
def _below(rate: float) -> int:
    return int(rate * 4294967296)


def _legit(table: str, key: str, long: bool) -> str:
    protocols = V.LEGIT_PROTOCOLS if long else V.SHORT_LEGIT_PROTOCOLS
    domains = V.LEGIT_DOMAINS if long else V.SHORT_LEGIT_DOMAINS
    paths = V.LEGIT_PATHS if long else V.SHORT_LEGIT_PATHS
    subs = V.LEGIT_SUBDOMAINS if long else V.SHORT_LEGIT_SUBDOMAINS
    id_query = "'?id=' || (d6 % 9900 + 100)"
    if long:
        query = f"""CASE WHEN d5 < {_below(0.15)} THEN {id_query}
            WHEN d5 < {_below(0.15 + 0.10)} THEN '?q=' || {_pick(V.SEARCH_TERMS, 'd6')}
            WHEN d5 < {_below(0.15 + 0.10 + 0.05)} THEN '?page=' || (d6 % 20 + 1) || '&sort=popular'
            ELSE '' END"""
    else:
        query = f"CASE WHEN d5 < {_below(0.2)} THEN {id_query} ELSE '' END"
    tail = f"{_pick(paths, 'd2')} || {query}"
    if long:
        tail = f"CASE WHEN d8 < {_below(0.15)} THEN '' ELSE {tail} END"
    return f"""SELECT k AS id, {_pick(protocols, 'd0')}
        || CASE WHEN d3 < {_below(0.15 if long else 0.1)} THEN {_pick(subs, 'd4')} || '.' ELSE '' END
        || {_pick(domains, 'd1')} || {tail} AS url, 0 AS label
      FROM (SELECT k, {_draws(3)} FROM
        (SELECT {key} AS k, {_digests('legit', key, 3)} FROM {table}))"""


def _phishing(table: str, key: str, long: bool) -> str:
    brands = V.PHISHING_BRANDS if long else V.SHORT_PHISHING_BRANDS
    brand, tld = _pick(brands, "d2"), _pick(V.PHISHING_TLDS, "d8")
    keywords, n = _list(V.PHISHING_KEYWORDS), len(V.PHISHING_KEYWORDS)
    joiner = _pick(V.JOINERS, "d3")
    combo = f"""w0 || {joiner} || w1 || CASE WHEN d12 % 2 = 1 THEN {joiner} || w2 ELSE '' END
        || {joiner} || {brand} || {tld}"""
    fake = f"""{brand} || '-' || w0 || {_pick(V.FAKE_EXTENSIONS, 'd9')} || '.' || w0 || '-'
        || {_pick(V.PHISHING_KEYWORDS, 'd5')} || {tld}"""
    nested = f"""{brand} || '.com.' || array_to_string(list_slice([w0, w1, w2, w3], 1, (d12 % 3 + 2)::INT), '.')
        || {tld}"""
    return f"""SELECT k AS id, CASE WHEN d1 % 4 = 2 THEN
        'http://' || (d4 % 255 + 1) || '.' || (d5 % 256) || '.' || (d6 % 256) || '.' || (d7 % 255 + 1)
          || '/' || {brand} || '/login'
        ELSE {_pick(V.PHISHING_PROTOCOLS, 'd0')}
          || CASE d1 % 4 WHEN 0 THEN {combo} WHEN 1 THEN {fake} ELSE {nested} END
          || {_pick(V.PHISHING_PATHS, 'd10')}
          || CASE WHEN d13 < {_below(0.4)} THEN '?token=' || (d14 % 900000 + 100000) || '&redirect=true'
             ELSE '' END END AS url, 1 AS label
      FROM (SELECT *, {_pick('list_filter(l2, lambda x: x <> w2)', 'd7', n - 3)} AS w3 FROM
      (SELECT *, list_filter(l1, lambda x: x <> w1) AS l2,
          {_pick('list_filter(l1, lambda x: x <> w1)', 'd6', n - 2)} AS w2 FROM
      (SELECT *, {_pick('l1', 'd5', n - 1)} AS w1 FROM
      (SELECT *, list_filter({keywords}, lambda x: x <> w0) AS l1 FROM
      (SELECT *, {_pick(V.PHISHING_KEYWORDS, 'd4')} AS w0 FROM
      (SELECT k, {_draws(4)} FROM
        (SELECT {key} AS k, {_digests('phish', key, 4)} FROM {table})))))))"""


def _balanced(table: str, key: str, long: bool = True, long_brands: bool = False) -> str:
    return f"""SELECT id * 2 AS id, url, label FROM ({_legit(table, key, long)})
      UNION ALL SELECT id * 2 + 1, url, label FROM ({_phishing(table, key, long_brands)})"""


def _links(table: str = "orders", key: str = "o_orderkey") -> str:
    return f"""({_balanced(table, key)}
      UNION ALL SELECT -page_id - 1, url, 0 FROM pages)"""


_ODD = f"""(SELECT id, label, CASE kind WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' 　 '
    WHEN 3 THEN regexp_replace(url, '^https?://(www\\.)?', '')
    WHEN 4 THEN '  ' || url || ' ' || chr(9) WHEN 5 THEN upper(url)
    WHEN 6 THEN replace(url, '://', '://me:pw@') WHEN 7 THEN url || '#top?x=1'
    WHEN 8 THEN replace(url, '://', '://[')
    WHEN 9 THEN 'http://[2001:db8::1]:8080/' || id || ';v=1?a=b'
    WHEN 10 THEN 'http://²' || id || '.٣.example.tk/'
    WHEN 11 THEN url || ';p=1/x;q=2?y'
    WHEN 12 THEN 'https://a／' || id || '.com/update?z'
    WHEN 13 THEN regexp_replace(url, '^(https?://[^/?]*)', '\\1:8080')
    WHEN 14 THEN regexp_replace(url, '^https?:', '') ELSE url END AS url
  FROM (SELECT *, ('0x' || substr(md5('7:odd:' || id), 1, 8))::BIGINT % 16 AS kind
        FROM {_links()}))"""

# One pattern over the whole URL, where the jobs cut the text step by step.
_SHAPE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_PARAM_SCHEMES = (
    "'', 'ftp', 'hdl', 'prospero', 'http', 'imap', 'https', 'shttp', 'rtsp', 'rtsps', 'rtspu', "
    "'sip', 'sips', 'mms', 'sftp', 'tel'"
)


def _parts(source: str) -> str:
    group = lambda i: f"regexp_extract(c, {_text(_SHAPE)}, {i})"
    return f"""(SELECT * EXCLUDE (c, s, n, p, q),
        CASE WHEN invalid THEN 'http' ELSE s END AS scheme,
        CASE WHEN invalid THEN 'error.com' ELSE n END AS netloc,
        CASE WHEN invalid THEN '' WHEN s IN ({_PARAM_SCHEMES}) THEN regexp_replace(p, ';[^/]*\\z', '')
          ELSE p END AS path,
        CASE WHEN invalid THEN '' ELSE q END AS query
      FROM (SELECT *, (contains(n, '[') <> contains(n, ']')) OR regexp_matches(n, '[／]')
          OR (contains(n, '[') AND NOT regexp_matches(n, '^[^\\[]*\\[[0-9A-Fa-f:.]+\\]')) AS invalid
      FROM (SELECT *, lower({group(1)}) AS s, {group(2)} AS n, {group(3)} AS p, {group(4)} AS q
      FROM (SELECT *, regexp_replace(regexp_replace(url, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g') AS c
      FROM {source}))))"""


def _features(source: str, keep: str = "id, label") -> str:
    count = lambda text, pattern: (
        f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"
    )
    specials = r"[!#$%^&*()=+\[\]{}|;:'',<>?]"
    tlds = "|".join(t[1:] for t in V.SUSPICIOUS_TLDS)
    columns = {
        "url_length": "length(url)",
        "domain_length": "length(netloc)",
        "path_length": "length(path)",
        "num_dots": count("url", "[.]"),
        "num_hyphens": count("netloc", "-"),
        "num_subdomains": count("netloc", "[.]"),
        "has_https": "scheme = 'https'",
        "has_ip": r"regexp_matches(netloc, '\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}')",
        "has_at_symbol": "contains(url, '@')",
        "num_special_chars": count("url", specials),
        "digits_in_domain": count("netloc", r"[\p{Nd}²³¹]"),
        "suspicious_tld": rf"regexp_matches(netloc, '\.({tlds})\z')",
        **{f"has_{w}": f"contains(lower(url), '{w}')" for w in V.RISK_WORDS},
        "has_query": "query <> ''",
    }
    listed = ", ".join(f"({columns[f]})::INT AS {f}" for f in V.FEATURES)
    return f"(SELECT {keep}, {listed} FROM {_parts(source)})"


_BLANKS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}]"
)
_TRIMMED = f"regexp_replace(regexp_replace(url, '^{_BLANKS}+', ''), '{_BLANKS}+\\z', '')"


def _normalised(text: str, prefix: str) -> str:
    return f"""SELECT id, CASE WHEN starts_with(t, 'http') THEN t ELSE '{prefix}' || t END AS url
      FROM (SELECT id, {text} AS t FROM {_ODD}) WHERE length(t) > 0"""


def _yes_no(column: str) -> str:
    return f"CASE WHEN {column} = 1 THEN 'Yes' WHEN {column} IS NOT NULL THEN 'No' END"


def _flags(source: str) -> str:
    limits = {
        "URL Length": ("url_length", 75),
        "Domain Length": ("domain_length", 30),
        "Dots in URL": ("num_dots", 3),
        "Domain Hyphens": ("num_hyphens", 1),
    }
    judged = {
        "HTTPS": ("has_https", "good", "bad"),
        "IP Address": ("has_ip", "bad", "good"),
        "Suspicious TLD": ("suspicious_tld", "bad", "good"),
        "Has 'login'": ("has_login", "warn", ""),
        "Has 'secure'": ("has_secure", "warn", ""),
        "Has 'verify'": ("has_verify", "warn", ""),
    }
    rows = [
        f"SELECT id, {_text(t)} AS feature, {c}::VARCHAR AS value, "
        f"CASE WHEN {c} > {n} THEN 'warn' WHEN {c} IS NOT NULL THEN '' END AS severity FROM f"
        for t, (c, n) in limits.items()
    ] + [
        f"SELECT id, {_text(t)}, {_yes_no(c)}, "
        f"CASE WHEN {c} = 1 THEN '{y}' WHEN {c} IS NOT NULL THEN '{n}' END FROM f"
        for t, (c, y, n) in judged.items()
    ]
    return f"WITH f AS {source} " + " UNION ALL ".join(rows)


def _describe(source: str, columns: list[str], digits: int | None = 2) -> str:
    shown = (lambda c: f"round({c}, {digits})") if digits is not None else (lambda c: c)
    stats = {
        "mean": "avg(v)",
        "std": "stddev_samp(v)",
        "min": "min(v)",
        "p25": "quantile_cont(v, 0.25)",
        "p50": "quantile_cont(v, 0.5)",
        "p75": "quantile_cont(v, 0.75)",
        "max": "max(v)",
    }
    listed = ", ".join(f"{shown(c)} AS {n}" for n, c in stats.items())
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM src" for c in columns)
    return f"""WITH src AS (SELECT * FROM {source}), long AS ({rows})
      SELECT feature, count(v)::BIGINT AS count, {listed} FROM long GROUP BY feature"""


_KEY = "md5('42:' || id)"


def _ranked(source: str) -> str:
    return f"""(SELECT id, label, {_KEY} AS key,
    row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS rn,
    count(*) OVER (PARTITION BY label) AS nk, count(*) OVER () AS n FROM {source})"""


def _split(source: str) -> str:
    """Test rows per class: the whole part of the share, and one more for the largest fractions."""
    ranked = _ranked(source)
    return f"""(SELECT r.id, r.label, r.rn <= s.take AS is_test FROM {ranked} r JOIN (
    SELECT label, floor(share)::BIGINT + (CASE WHEN row_number() OVER (
        ORDER BY share - floor(share) DESC, label) <= n_test - sum(floor(share)) OVER ()
        THEN 1 ELSE 0 END) AS take
    FROM (SELECT label, n_test, n_test * nk / n::DOUBLE AS share FROM (
        SELECT DISTINCT label, nk, n, ceil(0.2 * n)::BIGINT AS n_test FROM {ranked}))) s
    ON r.label = s.label)"""


def _folds(source: str) -> str:
    """Fold sizes come from dealing the label-sorted rows out in turn; folds are runs in hash order."""
    ranked = _ranked(source)
    return f"""(WITH dealt AS (SELECT label, (row_number() OVER (ORDER BY label) - 1) % 5 AS fold
    FROM {ranked}),
  ends AS (SELECT label, fold, sum(c) OVER (PARTITION BY label ORDER BY fold) AS last
    FROM (SELECT label, fold, count(*) AS c FROM dealt GROUP BY label, fold))
  SELECT r.id, r.label, min(e.fold)::INT AS fold FROM {ranked} r
  JOIN ends e ON e.label = r.label AND r.rn <= e.last GROUP BY r.id, r.label)"""


_SPLIT = _split(_links())
# The training table of the models: a tenth of the labels is wrong.
_NOISY = f"""(SELECT id, url, CASE WHEN wrong THEN 1 - label ELSE label END AS label, wrong
  FROM (SELECT *, ('0x' || substr(md5('11:noise:' || id), 1, 8))::BIGINT % 10 = 0 AS wrong
    FROM {_links()}))"""
_MANY = """(SELECT line * 16 + k AS id, line * 2 + k % 2 AS label
  FROM (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS line FROM lineitem), range(0, 11) AS s(k))"""
_WIDE = "(SELECT vec_id AS id, (label < 5)::INT AS label FROM embeddings)"


def _models(*names: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {_text(n)} AS model" for n in names) + ")"


def _run_summary(source: str, *names: str) -> str:
    return f"""SELECT model, n_train, n_test_0, n_test_1, TRUE AS scores_ok, TRUE AS accuracy_ok,
      TRUE AS auc_ok, TRUE AS measures_ok FROM {_models(*names)},
      (SELECT count(*) FILTER (WHERE NOT is_test) AS n_train,
        count(*) FILTER (WHERE is_test AND label = 0) AS n_test_0,
        count(*) FILTER (WHERE is_test AND label = 1) AS n_test_1 FROM {_split(source)})"""


def _scored_summary(source: str, key: str) -> str:
    return f"""SELECT {key}, {', '.join(V.FEATURES)}, TRUE AS verdict_ok, TRUE AS confidence_ok,
      TRUE AS percent_ok FROM {_features(source, key)}"""


def _scaled() -> str:
    stats = ", ".join(
        f"avg({f}) FILTER (WHERE NOT is_test) OVER () AS m_{f}, "
        f"stddev_pop({f}) FILTER (WHERE NOT is_test) OVER () AS s_{f}"
        for f in V.FEATURES
    )
    # Rounding noise around zero may differ in sign between engines.
    listed = ", ".join(
        f"round(({f} - m_{f}) / CASE WHEN s_{f} > 1e-12 THEN s_{f} ELSE 1 END, 6) + 0.0 AS scaled_{f}"
        for f in V.FEATURES
    )
    return f"""SELECT id, is_test, {listed} FROM (SELECT *, {stats} FROM
      (SELECT f.*, s.is_test FROM {_features(_links())} f JOIN {_SPLIT} s ON f.id = s.id))"""


_RULES = {
    "by_discount": "l_discount * 10 + l_tax",
    "by_mix": "(l_quantity / 50 + l_discount * 10) / 2",
    "by_price": "l_extendedprice / 100000",
    "by_quantity": "l_quantity / 50",
}
_SCORED = (
    "("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, (l_orderkey % 5)::INT AS fold, (l_returnflag = 'R')::INT AS label, "
        f"({rule} >= 0.5)::INT AS prediction, {rule} AS score FROM lineitem"
        for m, rule in _RULES.items()
    )
    + ")"
)
_CELLS = (
    "(SELECT model, "
    + ", ".join(
        f"count(*) FILTER (WHERE label = {a} AND prediction = {p}) AS c{a}{p}"
        for a in (0, 1)
        for p in (0, 1)
    )
    + f" FROM {_SCORED} GROUP BY model)"
)


def _scores(positive: int = 1) -> str:
    tp, fp, fn = ("c11", "c01", "c10") if positive else ("c00", "c10", "c01")
    return f"""(SELECT *, round((c00 + c11) / (c00 + c01 + c10 + c11)::DOUBLE, 4) AS accuracy,
      round(coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 0), 4) AS precision,
      round(coalesce({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 0), 4) AS recall,
      round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE, 0), 4) AS f1_score
      FROM {_CELLS})"""


def _points(positive: int = 1) -> str:
    """Every distinct score with its counts and what lies above and below it."""
    by = "PARTITION BY model ORDER BY score DESC"
    return f"""(SELECT *, sum(tp) OVER ({by}) AS ctp, sum(fp) OVER ({by}) AS cfp,
      row_number() OVER ({by}) AS rank, lead(tp) OVER ({by}) AS ntp, lead(fp) OVER ({by}) AS nfp,
      sum(tp) OVER (PARTITION BY model) AS p, sum(fp) OVER (PARTITION BY model) AS n
      FROM (SELECT model, score, count(*) FILTER (WHERE label = {positive}) AS tp,
        count(*) FILTER (WHERE label <> {positive}) AS fp FROM {_SCORED} GROUP BY model, score))"""


def _roc(thin: bool = True) -> str:
    kept = "rank = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp" if thin else "true"
    return f"""(SELECT model, 0::BIGINT AS rank, 'Infinity'::DOUBLE AS threshold, 0::DOUBLE AS fpr,
        0::DOUBLE AS tpr FROM {_points()} WHERE rank = 1
      UNION ALL SELECT model, rank::BIGINT, score, cfp::DOUBLE / n::DOUBLE, ctp::DOUBLE / p::DOUBLE
      FROM {_points()} WHERE {kept})"""


def _auc(positive: int = 1, digits: int = 4) -> str:
    return f"""(SELECT model, round(sum(fp::HUGEINT * (2 * ctp - tp))::DOUBLE
      / (2.0 * max(p)::DOUBLE * max(n)::DOUBLE), {digits}) AS auc_roc
      FROM {_points(positive)} GROUP BY model)"""


_CV = f"""(SELECT model, round(avg(a), 4) AS cv_mean, round(stddev_pop(a), 4) AS cv_std FROM (
    SELECT model, fold, avg((prediction = label)::INT) AS a FROM {_SCORED} GROUP BY model, fold)
  GROUP BY model)"""
_METRICS = f"""(SELECT s.model, s.accuracy, s.precision, s.recall, s.f1_score, a.auc_roc,
    c00, c01, c10, c11, cv_mean, cv_std
  FROM {_scores()} s JOIN {_auc()} a ON s.model = a.model JOIN {_CV} v ON s.model = v.model)"""
_ORDER = _list(SCORED_MODELS)
_BEST = f"(SELECT * FROM {_scores()} ORDER BY f1_score DESC, list_position({_ORDER}, model) LIMIT 1)"
_TITLES = {
    "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall",
    "f1_score": "F1-Score", "auc_roc": "AUC-ROC",
}


def _percent(column: str) -> str:
    return f"format('{{:.1f}}%', {column} * 100)"


_SPREAD = f"""(SELECT feature, round(std / sum(std) OVER (), 6) AS importance,
    (list_position({_list(V.FEATURES)}, feature) - 1)::INT AS position
  FROM ({_describe(_features(_links()), V.FEATURES, None)}))"""
_SHOWN_NAMES = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in V.FEATURE_TITLES.items())


def oracles() -> dict[str, str]:
    features = _features(_links())
    names = ", ".join(V.FEATURES)
    return {
        "url_parts": f"SELECT id, scheme, netloc, path, query, invalid FROM {_parts(_ODD)}",
        "url_features": f"SELECT * FROM {features}",
        "url_features_odd_input": f"SELECT * FROM {_features(_ODD, 'id')}",
        "url_rejects": f"""SELECT CASE WHEN url IS NULL THEN 'rejected' ELSE 'scored' END AS kind,
          count(*)::BIGINT AS n, count(url)::BIGINT AS with_url FROM {_ODD} GROUP BY url IS NULL""",
        "url_normalise_web": _normalised("url", "https://"),
        "url_normalise_console": _normalised(_TRIMMED, "http://"),
        "url_risk_flags": _flags(features),
        "url_risk_flags_odd_input": _flags(_features(_ODD, "id")),
        "url_key_features_odd_input": f"""SELECT id, url_length, num_dots, num_hyphens,
          {_yes_no('has_https')} AS uses_https, {_yes_no('suspicious_tld')} AS suspicious_tld,
          {_yes_no('has_ip')} AS has_ip, {_yes_no('has_login')} AS has_login,
          {_yes_no('has_secure')} AS has_secure FROM {_features(_ODD, 'id')}""",
        "url_key_features": f"""SELECT id, url_length, num_dots, num_hyphens,
          {_yes_no('has_https')} AS uses_https, {_yes_no('suspicious_tld')} AS suspicious_tld,
          {_yes_no('has_ip')} AS has_ip, {_yes_no('has_login')} AS has_login,
          {_yes_no('has_secure')} AS has_secure FROM {features}""",
        "legit_links_short": _legit("orders", "o_orderkey", False),
        "legit_links_long": _legit("orders", "o_orderkey", True),
        "phishing_links_short": _phishing("orders", "o_orderkey", False),
        "phishing_links_long": _phishing("orders", "o_orderkey", True),
        "balanced_links": _balanced("orders", "o_orderkey"),
        "balanced_links_short": _balanced("orders", "o_orderkey", False, True),
        "shuffled_links": f"""SELECT *, {_KEY} AS position_key
          FROM {_links()} ORDER BY position_key""",
        "table_shape": f"SELECT count(*)::BIGINT AS n_rows, 20 AS n_columns FROM {features}",
        "class_counts": f"SELECT label, count(*)::BIGINT AS n FROM {_links()} GROUP BY label",
        "class_filter": f"SELECT * FROM {features} WHERE label = 1",
        "feature_projection": f"SELECT id, {names} FROM {features}",
        "describe_features": _describe(features, [*V.FEATURES, "label"]),
        "describe_line_items": _describe(
            "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        ),
        "describe_with_empty_column": _describe(
            "(SELECT l_quantity, NULL::DOUBLE AS nothing FROM lineitem)", ["l_quantity", "nothing"]
        ),
        "noisy_class_counts": f"""SELECT label, count(*) AS n, count(*) FILTER (WHERE wrong) AS n_wrong
          FROM {_NOISY} GROUP BY label""",
        "head_features": f"SELECT * FROM {features} ORDER BY id LIMIT 3",
        "first_examples": f"SELECT label, arg_min(url, id) AS url FROM {_links()} GROUP BY label",
        "stratified_split": f"SELECT * FROM {_SPLIT}",
        "stratified_split_of_many_classes": f"SELECT * FROM {_split(_MANY)}",
        "stratified_folds": f"SELECT * FROM {_folds(_links())}",
        "sample_per_class": f"""SELECT id, url, label FROM (SELECT *, row_number() OVER (
          PARTITION BY label ORDER BY md5('99:' || id)) AS rn FROM {_links()}) WHERE rn <= 5""",
        "scaled_features": _scaled(),
        "confusion_cells": f"SELECT * FROM {_CELLS}",
        "class_scores": f"SELECT * FROM {_scores()}",
        "class_scores_other_polarity": f"SELECT * FROM {_scores(0)}",
        "roc_points": f"SELECT * FROM {_roc()}",
        "roc_points_all": f"SELECT * FROM {_roc(False)}",
        "roc_points_bounded": f"""SELECT model, rank, threshold, fpr, tpr, TRUE AS area_ok FROM (
          SELECT *, row_number() OVER (PARTITION BY model, floor(fpr / 0.05), floor(tpr / 0.05) ORDER BY rank) AS first,
            row_number() OVER (PARTITION BY model, floor(fpr / 0.05), floor(tpr / 0.05) ORDER BY rank DESC) AS last
          FROM {_roc(False)}) WHERE first = 1 OR last = 1""",
        "roc_auc": f"SELECT * FROM {_auc(digits=9)}",
        "roc_auc_other_polarity": f"SELECT * FROM {_auc(0)}",
        "metrics_table": f"SELECT * FROM {_METRICS}",
        "fold_scores": f"SELECT * FROM {_CV}",
        "best_model": f"SELECT * FROM {_BEST}",
        "score_tally": f"""SELECT model, count(*) FILTER (WHERE prediction = label) AS correct,
          count(*) AS total, round(count(*) FILTER (WHERE prediction = label) * 100.0 / count(*), 0)
          AS percent FROM {_SCORED} GROUP BY model""",
        "hit_marks": f"""SELECT model, CASE WHEN prediction = label THEN 'OK' ELSE 'MISS' END AS mark,
          count(*) AS n FROM {_SCORED} GROUP BY ALL""",
        "verdicts": f"""SELECT model, label, prediction, score,
          CASE WHEN prediction = 1 THEN 'PHISHING' ELSE 'SAFE' END AS verdict,
          CASE WHEN prediction = 1 THEN 'Legitimate' ELSE 'Phishing' END AS page_class,
          round(sure, 9) AS confidence, round(greatest(score, 1 - score), 9) AS top_confidence,
          greatest(0, least(100, trunc(round(sure, 9) * 100)::INT))::INT AS confidence_percent
          FROM (SELECT *, CASE WHEN prediction = 1 THEN score ELSE 1 - score END AS sure
            FROM {_SCORED})""",
        "metric_comparison": " UNION ALL ".join(
            f"SELECT model, '{title}' AS metric, {c} AS value FROM {_METRICS}"
            for c, title in _TITLES.items()
        ),
        "confusion_chart": " UNION ALL ".join(
            f"SELECT model, '{an}' AS actual, '{pn}' AS predicted, c{a}{p} AS n FROM {_CELLS}"
            for a, an in enumerate(("Safe", "Phishing"))
            for p, pn in enumerate(("Safe", "Phishing"))
        ),
        "summary_table": f"""SELECT model, {', '.join(
            f"format('{{:.4f}}', {c}) AS {c}" for c in _TITLES)},
          format('{{:.4f}} ± {{:.4f}}', cv_mean, cv_std) AS cv,
          row_number() OVER (ORDER BY f1_score DESC, list_position({_ORDER}, model)) = 1 AS is_best
          FROM {_METRICS}""",
        "performance_table": f"""SELECT model, {_percent('accuracy')} AS accuracy,
          {_percent('precision')} AS precision, {_percent('recall')} AS recall,
          format('{{:.4f}}', f1_score) AS f1_score, {_percent('auc_roc')} AS auc_roc FROM {_METRICS}""",
        "metric_cards": f"""SELECT model AS best_model, {_percent('accuracy')} AS accuracy,
          (SELECT count(*) FROM {_links()}) AS n_links FROM {_BEST}""",
        "feature_ranking": f"SELECT * FROM {_SPREAD} ORDER BY importance DESC, position",
        "feature_ranking_top15": f"SELECT * FROM {_SPREAD} ORDER BY importance DESC, position LIMIT 15",
        "feature_ranking_chart": f"""SELECT CASE feature {_SHOWN_NAMES} ELSE feature END AS feature,
          importance, position FROM {_SPREAD} ORDER BY importance, position DESC""",
        "csv_links": f"""SELECT id, label, FALSE AS is_bad, CASE ((id % 5) + 5) % 5
          WHEN 0 THEN url || chr(10) || chr(13) || chr(10) || '\\n\\\\b,"x"'
          WHEN 1 THEN '\\N' || url || chr(13)
          WHEN 2 THEN CASE WHEN id % 7 = 0 THEN '\\N' ELSE url END ELSE url END AS url FROM {_ODD}""",
        "csv_features": f"SELECT *, FALSE AS is_bad FROM {features}",
        "csv_features_without_ids": f"""SELECT label, count(*) AS n, count(*) AS n_ids,
          {', '.join(f'sum({f})::BIGINT AS {f}' for f in V.FEATURES)} FROM {features} GROUP BY label""",
        "csv_of_another_tool": """SELECT page_id, md5(url || chr(10) || '"x", y') AS link_md5, md5(html) AS html_md5,
          page_id / 4.0 AS quarter, FALSE AS is_bad FROM pages""",
        "json_metrics": f"SELECT * FROM {_METRICS}",
        "json_roc": f"""SELECT model, count(*) AS n, max(rank) AS last_rank,
          round(sum(fpr), 4) AS sum_fpr, round(sum(tpr), 4) AS sum_tpr FROM {_roc()} GROUP BY model""",
        "logistic_regression_metrics": _run_summary(_NOISY, L.LOGREG),
        "random_forest_metrics": _run_summary(_NOISY, L.FOREST),
        "kernel_svm_metrics": _run_summary(_NOISY, L.SVM),
        "boosted_trees_metrics": _run_summary(_NOISY, L.BOOSTED),
        "model_comparison": _run_summary(_NOISY, *L.MODEL_ORDER),
        "wide_table_comparison": _run_summary(_WIDE, *L.MODEL_ORDER),
        "cross_validation": f"""SELECT model, fold, count(*) AS n, TRUE AS accuracy_ok
          FROM {_models(*L.MODEL_ORDER)}, {_folds(f'(SELECT * FROM {_split(_NOISY)} WHERE NOT is_test)')}
          GROUP BY model, fold""",
        "forest_importance": " UNION ALL ".join(
            f"SELECT '{L.FOREST}' AS model, '{f}' AS feature, {i} AS position, "
            f"(SELECT min({f}) != max({f}) FROM {features}) AS varies, "
            "TRUE AS importance_ok, TRUE AS total_ok, TRUE AS rank_ok"
            for i, f in enumerate(V.FEATURES)
        ),
        "scored_links": _scored_summary(f"({_normalised(_TRIMMED, 'https://')})", "id"),
        "scored_rejects": f"""SELECT id, url, label, CASE WHEN url IS NULL THEN 'no url'
          ELSE 'blank url' END AS reason FROM {_ODD} WHERE url IS NULL OR length({_TRIMMED}) = 0""",
        "stream_scored_links": _scored_summary("(SELECT page_id, url FROM pages)", "page_id"),
        "stream_scores_and_rejects": """SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN url WHEN page_id % 8 = 0 THEN ' ' END AS url,
          CASE WHEN page_id % 8 = 0 THEN 'blank url' WHEN page_id % 4 = 0 THEN 'no url' END AS reason, TRUE AS verdict_ok
          FROM pages""",
        "stream_rejects": """SELECT page_id, CASE WHEN page_id % 8 = 0 THEN ' ' END AS url,
          CASE WHEN page_id % 8 = 0 THEN 'blank url' ELSE 'no url' END AS reason
          FROM pages WHERE page_id % 4 = 0""",
        "saved_model_retest": f"""SELECT id, label,
          CASE WHEN label = 1 THEN 'Phishing' ELSE 'Legitimate' END AS actual,
          TRUE AS predicted_ok, TRUE AS confidence_ok, TRUE AS mark_ok
          FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('99:' || id)) AS rn
            FROM {_NOISY}) WHERE rn <= 5""",
        "stream_url_features": f"""SELECT page_id, {names} FROM
          {_features('(SELECT page_id, url FROM pages)', 'page_id')}""",
    }
