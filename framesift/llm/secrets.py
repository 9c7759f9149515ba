"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates in each text; their values are hashed, and the hashes are counted by distinct repositories
and distinct owners over the whole corpus. A value that several owners have, or very many repositories, is a copied
example; one that few have looks live. Candidates of the loose kinds (long mixed tokens, web tokens) count as findings only if they look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import bounded, frozen


@dataclass(frozen=True)
class Kind:
    """A pattern with the group that holds the value, the least length of that value, and what else it must match."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    also: tuple[str, ...] = ()


#: Findings wherever they are. Runs below the least length match nothing else, so hex and access ask for it in the pattern.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Findings only if the corpus has them with few owners.
LOOSE = (
    Kind("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("mixed", r"[A-Za-z0-9+/_-]{32,}", 0, 32, (r"[0-9]", r"[a-z]", r"[A-Z]")),
)
#: Values of this many owners or more, or of this many repositories, are copied examples.
COPIED_OWNERS, COPIED_REPOS = 3, 50
#: Matches whose places are summed up together; longer lists are summed in two steps.
RUN = 256


def _starts(lengths: Column) -> Column:
    """Running sums of an array: element i holds the sum of the elements before i. Two levels, so that a text full of matches costs little."""

    def within(xs: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("at")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["at"], F.array(acc["sum"])).alias("at")),
        )

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda i: within(F.slice(lengths, i * RUN + 1, RUN)))
    return F.transform(
        F.array(runs),
        lambda rs: F.flatten(F.zip_with(rs, within(F.transform(rs, lambda r: r["sum"]))["at"], lambda r, base: F.transform(r["at"], lambda at: at + base))),
    )[0]


def _found(text: Column, kind: Kind) -> Column:
    """Leftmost non-overlapping matches: array of kind, start, end (code points, end exclusive), value."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else hits
    # the gaps between matches and the matches themselves alternate; their lengths sum up to the places
    pairs = F.zip_with(F.arrays_zip(hits.alias("hit"), values.alias("value")), F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits)), lambda h, gap: F.struct(h["hit"].alias("hit"), h["value"].alias("value"), F.length(gap).cast("long").alias("gap")))
    spans = F.transform(
        F.array(pairs),
        lambda ps: F.zip_with(
            ps,
            _starts(F.transform(ps, lambda p: p["gap"] + F.length(p["hit"]))),
            lambda p, at: F.struct(F.lit(kind.name).alias("kind"), (at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["hit"])).alias("end"), p["value"].alias("value")),
        ),
    )[0]

    def holds(s: Column) -> Column:
        ok = F.length(s["value"]) >= kind.least
        for pattern in kind.also:
            ok = ok & s["value"].rlike(pattern)
        return ok

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(kind.pattern), F.filter(spans, holds)).otherwise(none)


def _joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind in the order of kinds, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("text")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["text"]), ",")


def _frequency(each: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """hash, n_owners, n_repos, live of (hash, owner, repo). One row for each hash, owner and repository first, so that a value in a third of the corpus is merged before it is dealt out."""
    return (
        each.groupBy("hash", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count("repo").alias("repos"))
        .groupBy("hash")
        .agg(F.count("owner").alias("n_owners"), F.sum("repos").alias("n_repos"))
        .withColumn("live", (F.col("n_owners") < copied_owners) & (F.col("n_repos") < copied_repos))
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_added.

    base_sha256 covers the spans of the base kinds; spans lists these and the loose candidates that look live. A
    value looks live if fewer than copied_owners owners and fewer than copied_repos repositories have it; n_live and
    n_copied count base spans either way. A null text is empty and has no span; null owners and null repositories count
    as none. An empty table gives an empty result; repeated rows each keep a row and count as one repository. Other
    columns of docs are ignored.
    """
    kinds = [k.name for k in (*BASE, *LOOSE)]
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("_text"))
    found = rows.select("row", "id", "repo", "owner", F.concat(*[_found(text, k) for k in BASE]).alias("base"), F.concat(*[_found(text, k) for k in LOOSE]).alias("loose"))
    hashed = lambda name: F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    # spans and hashes only: the texts, and the secrets in them, are not kept
    found = frozen(found.select("row", "id", "repo", "owner", hashed("base").alias("base"), hashed("loose").alias("loose")))

    each = found.filter((F.size("base") > 0) | (F.size("loose") > 0)).select("row", "repo", "owner", F.explode(F.concat("base", "loose")).alias("s"))
    # the copied values alone are joined: they are few beside their uses
    copied = frozen(_frequency(each.select(F.col("s.hash").alias("hash"), "owner", "repo"), copied_owners, copied_repos).filter(~F.col("live")).select("hash", F.lit(False).alias("live")))
    judged = each.select("row", "s.*").join(bounded(copied), "hash", "left").withColumn("live", F.coalesce("live", F.lit(True)))
    base_kind = F.col("kind").isin([k.name for k in BASE])
    verdicts = judged.groupBy("row").agg(
        F.count(F.when(base_kind & F.col("live"), 1)).alias("n_live"),
        F.count(F.when(base_kind & ~F.col("live"), 1)).alias("n_copied"),
        F.collect_list(F.when(~base_kind & F.col("live"), F.struct("kind", "start", "end", "hash"))).alias("added"),
    )
    out = found.join(verdicts, "row", "left")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    added = F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,hash:string>>"))
    return out.select(
        F.col("id").alias("doc_id"),
        *[number(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(_joined(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(F.col("base"), added), kinds).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.size(added).cast("long").alias("n_added"),
    )


def ownership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """A row for each candidate value: its hash, n_owners, n_repos and whether it looks live.

    Null and empty texts have no value; null owners and repositories count as none, repeated rows as one repository.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = F.transform(F.concat(*[_found(text, k) for k in (*BASE, *LOOSE)]), lambda s: F.sha2(s["value"], 256))
    return _frequency(docs.select(F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.explode(values).alias("hash")), copied_owners, copied_repos)
