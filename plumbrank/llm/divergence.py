"""Operator 11, an audit of how sources of a language differ in their terms.

1. Each task counts the terms of its texts, block by block, and sends on a row for each term
   of a source. Sums over tasks give what a source has of a term, and in how many documents
   of its language the term is; frequent terms are kept.
2. Kept terms are dealt into blocks by hash, sources likewise. A task has a block of terms
   and a pair of blocks of sources as a dense matrix of int64, source by term, whose cells
   are scaled shares. Broadcasting all pairs of its rows gives partial distances; the cells
   themselves give each source's best terms of the block.
3. Partial distances are summed; of the blocks' best terms the best stay.

All shares are whole numbers, divided digit by digit, so nothing is rounded on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import text as tx

#: Terms and sources of a tile, about: together 8 MB of cells.
TILE_TERMS, TILE_SOURCES = 4096, 256
#: Bytes of text that are counted at once.
COUNT_BYTES = 4 << 20
#: Shares are parts of 10 ** 9, reached in steps of a thousand: N + smooth * V may be up to 2 ** 63 / 1000.
STEPS, STEP = 3, 1000

#: Runs of letters and of every code point from U+0080 on (texts are lower-cased first).
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def terms(texts: tx.Texts) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, each distinct one once in the dictionary; and the text that each comes from."""
    texts = texts.lowered()
    at = tx.spans(texts, LETTERS)
    offsets = np.concatenate([[0], np.cumsum(at.ends - at.starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(at.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texts.data[LETTERS[texts.data]]))])
    return found.dictionary_encode(), at.text_of


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): what each block of texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tx.blocks(batch, "text", COUNT_BYTES):
                lang, source = (part.column(part.schema.get_field_index(x)).dictionary_encode() for x in ("lang", "source"))
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                term, text_of = terms(texts)
                size = max(len(term.dictionary), 1)
                pairs, count = np.unique(text_of * size + term.indices.to_numpy(), return_counts=True)
                key = group[pairs // size] * size + pairs % size
                order = np.argsort(key, kind="stable")
                key, count = key[order], count[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                group, which = key[first] // size, key[first] % size
                yield pa.RecordBatch.from_pydict({
                    "lang": lang.dictionary.take(pa.array(group // len(source.dictionary))),
                    "source": source.dictionary.take(pa.array(group % len(source.dictionary))),
                    "term": term.dictionary.take(pa.array(which)).cast(pa.string()),
                    "count": pa.array(np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)),
                    "docs": pa.array(np.diff(np.append(first, len(key)))),
                })

    return docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def shares(count: np.ndarray, total: np.ndarray, smooth: int, n_terms: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + smooth) / (total + smooth * n_terms)), exact for any sum below 2 ** 63 / 1000."""
    of = total + smooth * n_terms
    out, rest = np.divmod(count + smooth, of)
    for _ in range(STEPS):
        digit, rest = np.divmod(rest * STEP, of)
        out = out * STEP + digit
    return out + 1


def _tile(rows: pa.Table, groups: pa.Table, smooth: int, top: int) -> pa.Table:
    """Partial distances of a tile's sources, and their best terms where the tile's two blocks of sources are one."""
    order = pc.sort_indices(groups["source"])
    source, block, n = groups["source"].take(order).to_pylist(), *(groups[x].take(order).to_numpy() for x in ("block", "n"))
    lang, n_terms, n_lang, i, j = (groups[x][0].as_py() for x in ("lang", "n_terms", "n_lang", "i", "j"))
    one = i == j
    term = pc.unique(rows["term"]).sort() if rows.num_rows else pa.array([], pa.string())
    cells = np.zeros((len(source), len(term)), np.int64)
    in_lang = np.zeros(len(term), np.int64)
    if len(term):
        column = pc.index_in(rows["term"], term).to_numpy()
        cells[pc.index_in(rows["source"], pa.array(source)).to_numpy(), column] = rows["count"].to_numpy()
        in_lang[column] = rows["in_lang"].to_numpy()
    p = shares(cells, n[:, None], smooth, n_terms) if len(term) else cells
    # Rows of the first block against rows of the second; within one block each pair once.
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    distance = np.zeros((len(first), len(second)), np.int64)
    step = max(1, (4 << 20) // (8 * max(len(first) * len(second), 1)))
    for a in range(0, len(term), step):
        distance += np.abs(p[first, None, a : a + step] - p[None, second, a : a + step]).sum(axis=2)
    a, b = np.triu_indices(len(first), 1) if one else (x.ravel() for x in np.indices(distance.shape))
    names = np.array(source, dtype=object)
    parts = [("pair", names[first[a]], names[second[b]], distance[a, b])]
    if one and len(term):
        over = p - shares(in_lang, np.int64(n_lang), smooth, n_terms)[None]
        over[(cells == 0) | (over < 0)] = 0
        for g in range(len(source)):
            best = np.argsort(-over[g], kind="stable")[:top]  # terms are in order of their bytes
            best = best[over[g, best] > 0]
            parts.append(("term", np.repeat(names[g : g + 1], len(best)), np.array(term.take(pa.array(best)).to_pylist(), object), over[g, best]))
    return pa.concat_tables([pa.table({"lang": pa.array([lang] * len(v), pa.string()), "source": pa.array(s, pa.string()), "part": pa.array([kind] * len(v), pa.string()), "item": pa.array(x, pa.string()), "value": pa.array(v, pa.int64())}) for kind, s, x, v in parts])


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Terms are runs of letters (A-Z lower-cased) and of code points from U+0080 on; a language keeps
    those of at least `least_docs` of its documents. A share is 1 + floor(10 ** 9 (count +
    smooth) / (N + smooth V)), with N occurrences of the V kept terms. Part `pair`: the distance to each other
    source of the language, summed over shares. Part `term`: what the source's share of a term
    has over the language's, the `top` highest. Equal values go by the item's bytes. Null texts,
    languages and sources count as empty strings; repeated rows are documents; other columns are not
    read. A language without kept terms has distances of 0 and no terms; an empty table gives no rows.
    """
    of = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(y) for x, y in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = _counts(of).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = counted.withColumns({"in_docs": F.sum("docs").over(term), "in_lang": F.sum("count").over(term), "head": F.row_number().over(term.orderBy("source"))})
    kept = materialise(summed.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "count", "in_lang", (F.col("head") == 1).cast("long").alias("head")), "terms")
    languages = kept.groupBy("lang").agg(F.sum("head").alias("n_terms"), F.sum("count").alias("n_lang"))
    occurring = of.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(languages, "lang", "left")
    groups = materialise(occurring.fillna(0, ["n", "n_terms", "n_lang"]), "groups")
    n_terms = groups.agg(F.max("n_terms")).first()[0] or 0
    n_sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles, blocks = max(1, -(-n_terms // TILE_TERMS)), max(1, -(-n_sources // TILE_SOURCES))

    def dealt(df: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
        seats = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
        return df.withColumns({"block": own, "seat": F.explode(seats)}).withColumns({"i": F.col("seat.i"), "j": F.col("seat.j")}).drop("seat")

    rows = dealt(kept.withColumn("tile", F.pmod(F.xxhash64("term"), F.lit(tiles)).cast("int"))).select("lang", "tile", "i", "j", "source", "term", "count", "in_lang")
    sides = dealt(groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))))
    keys = ("lang", "tile", "i", "j")
    found = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(lambda left, right: _tile(left, right, smooth, top), "lang string, source string, part string, item string, value long")
    found = materialise(found, "tiles")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    mirrored = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.unionByName(mirrored).withColumn("rank", F.row_number().over(order))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best)


def divergence_query(docs: DataFrame) -> DataFrame:
    return divergence(docs.select("text", "lang", "source"))


def oracle_sql() -> str:
    """Counts by unnested terms, and a join of all kept terms with the sources of their language."""
    return r"""
    WITH d AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents
    ), w AS (
        SELECT doc, lang, source, unnest(words) AS term FROM d
    ), v AS (
        SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30
    ), l AS (
        SELECT lang, count(*) AS n_terms, sum(in_lang) AS n_lang FROM v GROUP BY lang
    ), g AS (
        SELECT DISTINCT lang, source FROM d
    ), c AS (
        SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL
    ), t AS (
        SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
    ), p AS (
        SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
            1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(t.n, 0) + 5 * l.n_terms) AS p,
            1 + CAST(1000000000 AS HUGEINT) * (v.in_lang + 5) // (l.n_lang + 5 * l.n_terms) AS q
        FROM g JOIN l USING (lang) JOIN v USING (lang)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
        LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
    ), f AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        UNION ALL
        SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        WHERE a.lang NOT IN (SELECT lang FROM l)
        UNION ALL
        SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
    )
    SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """
