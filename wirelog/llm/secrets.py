"""Secret scan with corpus-wide ownership of every candidate.

Patterns give candidates: assigned passwords and tokens, access keys, long hexadecimal runs, and
long mixed words. The value of each is hashed, and over the whole corpus the distinct repositories and
owners that carry a hash are counted. A value that many owners carry has been copied from an
example; one that stays with one owner, and looks random, looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named, packed, text_key, unpacked
from wirelog.llm.spans import listed, located

KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("mixed", "live", "copied")
#: A value with at least so many owners, or so many repositories, is a copied example.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 5
#: Distinct characters that a value must have to look random.
LIVE_CHARACTERS = 8

# Same matches as the plain patterns; runs that cannot match are tried once.
_ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr][Dd]|[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
)
_ACCESS = r"AKIA[A-Z0-9]{14,}+"
_HEX = r"[0-9a-f]{16,}+"
_MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+"


def _patterns(text: Column) -> dict:
    return {
        "assign": (_ASSIGN, 1, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))),
        "access": (_ACCESS, 0, F.contains(text, F.lit("AKIA"))),
        "hex": (_HEX, 0, F.lit(True)),
        "mixed": (_MIXED, 0, F.rlike(text, F.lit("[0-9]"))),
    }


def _number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *METHOD_KINDS)]), kind)


def scan_secrets(
    docs: DataFrame, text_column: str = "text", owner: Column | None = None, repository: Column | None = None,
    scratch: Scratch | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, or all) with counts, ``base_sha256`` and ``spans``.

    ``n_assign``, ``n_access``, ``n_hex`` count the patterns' spans and ``base_sha256`` digests
    them. ``spans`` lists these and, for each, a ``live`` or ``copied`` span around its value,
    and ``mixed`` words with theirs. ``n_live`` and ``n_copied`` count distinct values. ``owner`` is the column
    ``source`` unless given, ``repository`` the pair of source and language; a null owner or
    repository is one of its own. A null text counts as empty. Repeated rows add no
    owner; input columns named like a result are replaced; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    rows = docs.select(
        text_key(named(text_column)).alias("key"),
        F.coalesce(named(text_column), F.lit("")).alias("text"),
    )
    matches = located(rows, _patterns(F.col("text"))).where(
        "kind <> 'assign' OR length(value) >= 12"
    ).select("key", "kind", "start", "end", F.unhex(F.md5("value")).alias("value"), _looks_random(F.col("value")).alias("random"))
    matches = scratch.store(matches, "matches")
    carriers = docs.select(
        text_key(named(text_column)).alias("key"),
        F.xxhash64(F.struct(owner.alias("o"))).alias("owner"),
        F.xxhash64(F.struct(repository.alias("r"))).alias("repository"),
    ).distinct()
    ownership = scratch.store(
        matches.select("key", "value")
        .distinct()
        .join(carriers, "key")
        .select("value", "owner", "repository")
        .distinct()
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")),
        "ownership",
    )
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)
    judged = scratch.store(
        matches.join(ownership, "value").withColumn(
            "verdict", F.when(copied, "copied").when(F.col("random"), "live")
        ),
        "judged",
    )
    base = judged.where(F.col("kind").isin(*KINDS)).select("key", "kind", "start", "end", "value", "verdict")
    more = judged.where("kind = 'mixed' AND verdict IS NOT NULL").select("key", "kind", "start", "end")
    verdicts = judged.where("verdict IS NOT NULL").select("key", F.col("verdict").alias("kind"), "start", "end").distinct()
    order = F.struct(F.col("start"), _number(F.col("kind")), F.col("end"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    numbers = judged.groupBy("key").agg(
        *counts,
        F.count_distinct(F.when(F.col("verdict") == "live", F.col("value"))).alias("n_live"),
        F.count_distinct(F.when(F.col("verdict") == "copied", F.col("value"))).alias("n_copied"),
    )
    spans = base.select("key", "kind", "start", "end").unionByName(more).unionByName(verdicts)
    of_text = (
        numbers.join(listed(base, order, "base"), "key", "left").join(listed(spans, order, "spans"), "key", "left")
    )
    # Written, so that the join with the rows can split a text that very many rows have.
    of_text = scratch.store(of_text, "texts")
    names = keep or docs.columns
    rows = packed(docs.select(*[named(c) for c in dict.fromkeys([*names, text_column])]), key=text_key(named(text_column)))
    rows = rows.select(F.struct(*[named(c, "_row").alias(c) for c in names]).alias("_row"), "key")
    zero = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in (*KINDS, "live", "copied")}
    joined = rows.join(of_text, "key", "left").withColumns(
        zero | {"base_sha256": F.sha2(F.coalesce("base", F.lit("")), 256), "spans": F.coalesce("spans", F.lit(""))}
    )
    return unpacked(joined, names, [*zero, "base_sha256", "spans"])


def _looks_random(value: Column) -> Column:
    letters = F.array_distinct(F.split(value, ""))
    return (F.size(letters) >= LIVE_CHARACTERS) & F.rlike(value, F.lit("[0-9]"))
