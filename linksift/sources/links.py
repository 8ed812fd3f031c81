"""Labelled link tables built from any column of ids.

Each row is a function of (seed, id) alone, so the table does not depend on partitioning, a
lost task rebuilds the same rows, and the job is one map stage however many ids come in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linksift.functions import vocabulary as V
from linksift.functions.draws import between, draw, happens, pick, pick_from, row_hash

LEGIT, PHISHING = 0, 1


@dataclass(frozen=True)
class LegitStyle:
    """How legitimate links look."""

    protocols: list[str]
    domains: list[str]
    paths: list[str]
    subdomains: list[str]
    subdomain_rate: float
    id_rate: float
    search_rate: float = 0.0
    page_rate: float = 0.0
    bare_rate: float = 0.0


SHORT = LegitStyle(
    V.SHORT_LEGIT_PROTOCOLS,
    V.SHORT_LEGIT_DOMAINS,
    V.SHORT_LEGIT_PATHS,
    V.SHORT_LEGIT_SUBDOMAINS,
    subdomain_rate=0.1,
    id_rate=0.2,
)
LONG = LegitStyle(
    V.LEGIT_PROTOCOLS,
    V.LEGIT_DOMAINS,
    V.LEGIT_PATHS,
    V.LEGIT_SUBDOMAINS,
    subdomain_rate=0.15,
    id_rate=0.15,
    search_rate=0.10,
    page_rate=0.05,
    bare_rate=0.15,
)


def _with_draws(ids: DataFrame, id_col: str, seed: int, tag: str, digests: int) -> DataFrame:
    """Add 4 draws per digest, named d0, d1, ..."""
    hashed = ids.withColumns(
        {f"_h{i}": row_hash(seed, f"{tag}{i}", F.col(id_col)) for i in range(digests)}
    )
    return hashed.withColumns(
        {f"_d{4 * i + s}": draw(F.col(f"_h{i}"), s) for i in range(digests) for s in range(4)}
    )


def _drawn(slot: int) -> Column:
    return F.col(f"_d{slot}")


def legit_links(
    ids: DataFrame, id_col: str = "id", seed: int = 42, style: LegitStyle = LONG
) -> DataFrame:
    """G1 (``SHORT``) and G2 (``LONG``): (id, url, label 0)."""
    table = _with_draws(ids.select(F.col(id_col).alias("id")), "id", seed, "legit", 3)
    host = F.when(
        happens(style.subdomain_rate, _drawn(3)),
        F.concat(pick(style.subdomains, _drawn(4)), F.lit("."), pick(style.domains, _drawn(1))),
    ).otherwise(pick(style.domains, _drawn(1)))
    first = style.id_rate
    second, third = first + style.search_rate, first + style.search_rate + style.page_rate
    query = (
        F.when(
            happens(first, _drawn(5)),
            F.concat(F.lit("?id="), between(100, 9999, _drawn(6)).cast("string")),
        )
        .when(
            happens(second, _drawn(5)),
            F.concat(F.lit("?q="), pick(V.SEARCH_TERMS, _drawn(6))),
        )
        .when(
            happens(third, _drawn(5)),
            F.concat(
                F.lit("?page="),
                between(1, 20, _drawn(6)).cast("string"),
                F.lit("&sort=popular"),
            ),
        )
        .otherwise("")
    )
    rest = F.when(happens(style.bare_rate, _drawn(8)), "").otherwise(
        F.concat(pick(style.paths, _drawn(2)), query)
    )
    url = F.concat(pick(style.protocols, _drawn(0)), host, rest)
    return table.select("id", url.alias("url"), F.lit(LEGIT).alias("label"))


def phishing_links(
    ids: DataFrame,
    id_col: str = "id",
    seed: int = 42,
    brands: list[str] = V.SHORT_PHISHING_BRANDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, url, label 1) over four host patterns with equal rates, and the columns to ``keep``."""
    table = _with_draws(ids.select(F.col(id_col).alias("id"), *keep), "id", seed, "phish", 4)
    # Distinct keywords: each next word is picked from what the words before it left over.
    words = F.lit(V.PHISHING_KEYWORDS)
    n = len(V.PHISHING_KEYWORDS)
    table = table.withColumn("_w0", pick_from(words, n, _drawn(4)))
    left = words
    for i in (1, 2, 3):
        left = F.array_remove(left, F.col(f"_w{i - 1}"))
        table = table.withColumn(f"_w{i}", pick_from(left, n - i, _drawn(4 + i)))

    # Named once, so that the host patterns below share one evaluation.
    table = table.withColumns(
        {
            "_brand": pick(brands, _drawn(2)),
            "_tld": pick(V.PHISHING_TLDS, _drawn(8)),
            "_joiner": pick(V.JOINERS, _drawn(3)),
            "_pattern": _drawn(1) % 4,
        }
    )
    brand, tld, joiner, pattern = (F.col(c) for c in ("_brand", "_tld", "_joiner", "_pattern"))
    word = [F.col(f"_w{i}") for i in range(4)]
    combo = F.concat(
        word[0],
        joiner,
        word[1],
        F.when(_drawn(12) % 2 == 1, F.concat(joiner, word[2])).otherwise(""),
        joiner,
        brand,
        tld,
    )
    fake = F.concat(
        brand,
        F.lit("-"),
        word[0],
        pick(V.FAKE_EXTENSIONS, _drawn(9)),
        F.lit("."),
        word[0],
        F.lit("-"),
        pick(V.PHISHING_KEYWORDS, _drawn(5)),
        tld,
    )
    nested = F.concat(
        brand,
        F.lit(".com."),
        word[0],
        F.lit("."),
        word[1],
        F.when(_drawn(12) % 3 >= 1, F.concat(F.lit("."), word[2])).otherwise(""),
        F.when(_drawn(12) % 3 == 2, F.concat(F.lit("."), word[3])).otherwise(""),
        tld,
    )
    octets = [
        between(low, 255, _drawn(4 + i)).cast("string") for i, low in enumerate((1, 0, 0, 1))
    ]
    numeric = F.concat(F.lit("http://"), F.concat_ws(".", *octets), F.lit("/"), brand, F.lit("/login"))
    query = F.when(
        happens(0.4, _drawn(13)),
        F.concat(
            F.lit("?token="),
            between(100000, 999999, _drawn(14)).cast("string"),
            F.lit("&redirect=true"),
        ),
    ).otherwise("")
    host = F.when(pattern == 0, combo).when(pattern == 1, fake).otherwise(nested)
    named = F.concat(
        pick(V.PHISHING_PROTOCOLS, _drawn(0)), host, pick(V.PHISHING_PATHS, _drawn(10)), query
    )
    url = F.when(pattern == 2, numeric).otherwise(named)
    return table.select("id", url.alias("url"), F.lit(PHISHING).alias("label"), *keep)


def balanced_links(
    ids: DataFrame,
    id_col: str = "id",
    seed: int = 42,
    style: LegitStyle = LONG,
    brands: list[str] = V.SHORT_PHISHING_BRANDS,
) -> DataFrame:
    """One legitimate and one phishing link per id, from one scan; new ids stay unique."""
    legit = legit_links(ids, id_col, seed, style).select("id", F.col("url").alias("_legit"))
    both = phishing_links(legit, "id", seed, brands, ("_legit",))
    link = lambda at, url, label: F.struct((F.col("id") * 2 + at).alias("id"), F.col(url).alias("url"), F.lit(label).alias("label"))
    return both.select(F.inline(F.array(link(0, "_legit", LEGIT), link(1, "url", PHISHING))))
