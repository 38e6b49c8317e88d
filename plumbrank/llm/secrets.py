"""Operator 3, secret scans with multipart credential linking, in DataFrame operations.

Strong findings stand alone: assignments of a long value to a secret's name, access
key identifiers, and long hexadecimal runs. Weak candidates (short values, user
names, endpoints) say little alone; one is reported only where, within a scope of
code points, complementary parts stand with it: an identifier, a secret, an endpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The contract's patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Weak candidates, by the part that they would be of a credential.
IDENTIFIER = r"""(?i:user(?:_?name)?|login|account|access_?key(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|ssh)://[A-Za-z0-9._~%@:/?&=+-]{4,}"""
#: Code points between the nearest ends of two parts of one credential.
SCOPE = 240

#: Kinds as listed: their rank is the order of spans with the same start.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_identifier", "endpoint")
#: The part that each kind plays.
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret", "weak_secret": "secret", "weak_identifier": "identifier", "endpoint": "endpoint"}


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Spans of all matches, leftmost and not overlapping: array of (start, end, size of the group), in code points.

    The pieces between matches and the matches themselves tile the text, so
    positions are running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, F.length) if group is None else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    parts = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(lengths.alias("all"), sizes.alias("part")), lambda gap, m: F.struct(gap.alias("gap"), m["all"].alias("all"), m["part"].alias("part")))
    return F.when(text.rlike(pattern), parts)


def _candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each document and match (and one without a match where a document has none): _row, kind, start, end, part, and `_keep` on a document's first."""
    t = F.coalesce(F.col(text), F.lit(""))
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, None), "hex": (HEX, None), "weak_identifier": (IDENTIFIER, None), "endpoint": (ENDPOINT, None)}
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*([F.col(f"`{x}`") for x in keep] or [F.lit(0)])).alias("_keep"), *[_matches(t, p, g).alias(f"_{k}") for k, (p, g) in patterns.items()])
    kinds = [F.transform(F.col(f"_{k}"), lambda m, i: F.struct(F.lit(KINDS.index(k)).alias("kind"), i.alias("at"), m["gap"].alias("gap"), m["all"].alias("all"), m["part"].alias("part"))) for k in patterns]
    every = F.concat(*[F.coalesce(x, F.array().cast("array<struct<kind:int,at:int,gap:int,all:int,part:int>>")) for x in kinds])
    found = rows.select("_row", "_keep", F.posexplode_outer(every).alias("_at", "m"))
    found = found.select("_row", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_keep")).alias("_keep"), "m.*")
    found = found.repartition("_row")  # serves all windows and the grouping that follow
    so_far = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("all")).over(so_far)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("all"))
    # A short assigned value is a weak secret.
    weak = (F.col("kind") == 0) & (F.col("part") < ASSIGN_LEAST)
    return found.withColumn("kind", F.when(weak, F.lit(KINDS.index("weak_secret"))).otherwise(F.col("kind")))


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """The columns `keep` (default: all) and `findings`: array of (kind, start, end, base) in order of start, then kind.

    Base findings are always reported. A weak candidate is reported where both other
    sides that it needs are near: a weak secret needs an identifier or an endpoint, a
    weak identifier a secret, an endpoint a secret and an identifier, each with its
    nearest end at most `scope` code points away in the same document. That interval
    join is an ordered pass: the last end and the next start of each part, carried
    over a document's matches by windows, so no pair is listed.

    Positions are running sums over a document's matches. Matches are shuffled, and the
    columns `keep` once for each document beside its first match; rows are told apart by
    their place in the input, which has to come in the same order when it is read again.
    Null and empty texts have no findings; repeated rows stay apart; a
    column named `findings` is replaced.
    """
    keep = [x for x in (docs.columns if keep is None else keep) if x != "findings"]
    found = _candidates(docs, text, keep)
    part = F.element_at(F.array(*[F.lit(PARTS[k]) for k in KINDS]), F.col("kind") + 1)
    found = found.withColumn("part", F.when(F.col("kind").isNotNull(), part))
    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)

    def near(name: str) -> Column:
        last = F.max(F.when(F.col("part") == name, F.col("end"))).over(before)
        following = F.min(F.when(F.col("part") == name, F.col("start"))).over(after)
        return F.coalesce(last >= F.col("start") - scope, F.lit(False)) | F.coalesce(following <= F.col("end") + scope, F.lit(False))

    found = found.withColumns({f"_{x}": near(x) for x in ("secret", "identifier", "endpoint")})
    base = F.col("kind") <= 2
    linked = (
        F.when(F.col("kind") == KINDS.index("weak_secret"), F.col("_identifier") | F.col("_endpoint"))
        .when(F.col("kind") == KINDS.index("weak_identifier"), F.col("_secret"))
        .when(F.col("kind") == KINDS.index("endpoint"), F.col("_secret") & F.col("_identifier"))
    )
    entry = F.when(base | linked, F.struct("start", "kind", "end", base.alias("base")))
    rows = found.groupBy("_row").agg(F.first("_keep", ignorenulls=True).alias("_keep"), F.array_sort(F.collect_list(entry)).alias("f"))
    kind = F.array(*[F.lit(k) for k in KINDS])
    findings = F.transform("f", lambda x: F.struct(F.element_at(kind, x["kind"] + 1).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["base"].alias("base")))
    return rows.select(*(["_keep.*"] if keep else []), findings.alias("findings"))


def secrets_query(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each document's findings; null and empty texts have none."""
    found = find_secrets(docs, keep=["doc_id"])
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(F.filter("findings", lambda x: x["base"]), named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", named), ",").alias("spans"),
    )


#: The query in DuckDB's SQL; {assign} and the other names stand for the patterns above.
ORACLE = """
WITH m AS (
  SELECT row_number() OVER () AS r, doc_id, unnest([
    {{'kind': 0, 'p': '{assign}', 'g': 2}}, {{'kind': 1, 'p': '{access}', 'g': 0}}, {{'kind': 2, 'p': '{hex}', 'g': 0}},
    {{'kind': 4, 'p': '{identifier}', 'g': 0}}, {{'kind': 5, 'p': '{endpoint}', 'g': 0}}]) AS k, coalesce(text, '') AS t
  FROM documents
), hit AS (
  SELECT r, doc_id, CASE k.kind {all} END AS found, CASE k.kind {part} END AS part, CASE k.kind {gap} END AS gap, k.kind AS kind FROM m
), one AS (
  SELECT r, doc_id, kind, unnest(generate_series(1, len(found))) AS i, found, part, gap FROM hit
), placed AS (
  SELECT r, doc_id, i, length(found[i]) AS size, length(part[i]) AS part_size, kind,
    sum(length(gap[i]) + length(found[i])) OVER (PARTITION BY r, kind ORDER BY i) AS "end"
  FROM one
), kinds AS (
  SELECT r, doc_id, CASE WHEN kind = 0 AND part_size < {least} THEN 3 ELSE kind END AS kind, "end" - size AS start, "end" FROM placed
), parts AS (
  SELECT *, ['secret', 'identifier', 'secret', 'secret', 'identifier', 'endpoint'][kind + 1] AS part FROM kinds
), near AS (
  SELECT *, {near} FROM parts
  WINDOW b AS (PARTITION BY r ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY r ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), kept AS (
  SELECT r, kind, start, concat_ws(':', ['assign', 'access', 'hex', 'weak_secret', 'weak_identifier', 'endpoint'][kind + 1], start::BIGINT, "end"::BIGINT) AS s FROM near
  WHERE kind <= 2 OR (kind = 3 AND (near_identifier OR near_endpoint)) OR (kind = 4 AND near_secret) OR (kind = 5 AND near_secret AND near_identifier)
), docs AS (SELECT DISTINCT r, doc_id FROM m)
SELECT doc_id, count(*) FILTER (kind = 0)::BIGINT AS n_assign, count(*) FILTER (kind = 1)::BIGINT AS n_access, count(*) FILTER (kind = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind <= 2), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM docs LEFT JOIN kept USING (r) GROUP BY r, doc_id
"""


def oracle_sql() -> str:
    patterns = {0: ASSIGN, 1: ACCESS, 2: HEX, 4: IDENTIFIER, 5: ENDPOINT}
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    case = lambda f: " ".join(f"WHEN {k} THEN {f(k, p)}" for k, p in quoted.items())
    near = ", ".join(
        f"coalesce(max(\"end\") FILTER (part = '{x}') OVER b >= start - {SCOPE}, false) OR coalesce(min(start) FILTER (part = '{x}') OVER a <= \"end\" + {SCOPE}, false) AS near_{x}"
        for x in ("secret", "identifier", "endpoint")
    )
    return ORACLE.format(
        assign=quoted[0], access=quoted[1], hex=quoted[2], identifier=quoted[4], endpoint=quoted[5], least=ASSIGN_LEAST, near=near,
        all=case(lambda k, p: f"regexp_extract_all(t, '{p}', 0)"), part=case(lambda k, p: f"regexp_extract_all(t, '{p}', {2 if k == 0 else 0})"), gap=case(lambda k, p: f"string_split_regex(t, '{p}')"),
    )
