"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Spans come from splitting a text at a pattern: the lengths of the pieces and of the matches between them add up to the places.
Spans are found once and written; the rest works on rows that hold any. The secrets are hashed and counted over the whole
corpus: by repository and owner first, then by secret, so that a secret in very many rows is one row for each of its repositories
before it is counted. A secret of at least WIDE distinct owners is a copied example; others are live-looking. The join back is
salted, as a copied secret may stand in very many rows.

Sums and largest values along an array are taken by doubling, and texts are cut by blocks, so that a text with very many
secrets costs in proportion to its length (times the logarithm of their number).

Cases: null counts as empty; a text without secrets has counts 0 and an empty spans string; a null owner or repository counts as one
of its own; rows are told apart by id and text, so repeated rows get equal results, and of rows that share both each stays; columns
are selected by name, others are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import persisted

# Kind, pattern, group of the secret, least characters of it. Kinds in the order of the base list; those after it are added.
BASE = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
ADDED = [
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})", 1, 16),
]
#: Patterns that find the same spans where dropped matches cannot hide others: a run too short holds no longer one.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: What a text must hold for a kind to be looked for, by plain search.
HINTS = {"assign": (":", "="), "access": ("AKIA",), "jwt": ("eyJ",), "bearer": ("earer",)}
WIDE = 3
SALTS = 16
MASK = "[secret]"
#: Code points of a block by which texts are cut.
BLOCK = 1024
_SPANS = "array<struct<start:int,k:int,end:int,secret:string>>"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f taken over all values up to each, by doubling."""
    powers = F.array(*(F.lit(1 << k) for k in range(31)))
    step = lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, f(x, F.get(acc, i - p))).otherwise(x))
    return _let(values, lambda v: F.aggregate(F.filter(powers, lambda p: p < F.size(v)), v, step))


def _found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array of (start, order, end, secret) of one kind."""
    pattern = QUICK.get(kind, pattern)
    none = F.expr(f"cast(array() as {_SPANS})")
    there = text.rlike(pattern)
    if hints := [text.contains(h) for h in HINTS.get(kind, ())]:
        any_hint = hints[0]
        for h in hints[1:]:
            any_hint = any_hint | h
        there = any_hint & there
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(m: Column) -> Column:
        ends = _running(F.zip_with(m["gaps"], m["sizes"], lambda g, n: g + F.coalesce(n, F.lit(0))), lambda x, y: x + y)
        return F.transform(F.arrays_zip(ends.alias("end"), m["sizes"].alias("size"), m["secrets"].alias("secret")), lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(order).alias("k"), x["end"].alias("end"), x["secret"].alias("secret")))

    rows = _let(F.struct(gaps.alias("gaps"), sizes.alias("sizes"), secrets.alias("secrets")), placed)
    # The last piece ends the text, not a match.
    return F.when(there, F.filter(rows, lambda x: x["start"].isNotNull() & (F.length(x["secret"]) >= least))).otherwise(none)


def spans(text: Column, kinds: list[tuple] = BASE + ADDED) -> Column:
    """All spans of a text by start, then kind as listed: (start, k, end, secret), in code points, end exclusive."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_found(text, i, *k) for i, k in enumerate(kinds)]))


def _joined(rows: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in BASE + ADDED))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def _counted(order: int) -> Column:
    return F.size(F.filter("found", lambda x: x["k"] == order)).cast("bigint")


def owners(found: DataFrame) -> DataFrame:
    """secret hash, n_repos, n_owners, n_places; found: h, repo, owner."""
    once = found.groupBy("h", "repo", "owner").agg(F.count("*").alias("n"))
    return once.groupBy("h").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_places"))


def judged(rows: DataFrame, wide: int, salts: int) -> DataFrame:
    """id2, key2, examples (hashes of copied secrets), max_repos, max_owners of each row with secrets; rows: id, key, repo, owner, found."""
    secrets = rows.where(F.size("found") > 0).select("id", "key", "repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda x: F.xxhash64(x["secret"])))).alias("h"))
    common = owners(secrets).where("n_repos > 1").select("h", "n_repos", "n_owners", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    held = secrets.select("id", "key", "h", F.pmod("key", F.lit(salts)).cast("int").alias("salt")).join(common, ["h", "salt"], "left")
    each = held.groupBy("id", "key").agg(F.collect_set(F.when(F.col("n_owners") >= wide, F.col("h"))).alias("examples"), F.coalesce(F.max("n_repos"), F.lit(1)).alias("max_repos"), F.coalesce(F.max("n_owners"), F.lit(1)).alias("max_owners"))
    return each.withColumnsRenamed({"id": "id2", "key": "key2"})


def _judged_rows(docs: DataFrame, id_col: str, text_col: str, repo: str | Column, owner: str | Column, wide: int, salts: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(rows without secrets; rows with secrets and what is known of these), with all of docs in `row` if asked for."""
    known = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), known(repo).alias("repo"), known(owner).alias("owner"), spans(F.col(text_col)).alias("found"), *([F.struct(*docs.columns).alias("row")] if whole else []))
    rows = persisted(rows)
    some = rows.where(F.size("found") > 0)
    return rows.where(F.size("found") == 0), some.join(judged(rows, wide, salts), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str | Column = "source", owner: str | Column = "source", wide: int = WIDE, salts: int = SALTS) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, max_repos, max_owners.

    n_live and n_example: spans whose secret is live-looking, or a copied example. max_repos and max_owners: of the text's secrets, the
    most distinct repositories and owners that hold one; 0 without secrets.
    """
    none, some = _judged_rows(docs, id_col, text_col, repo, owner, wide, salts, False)

    def described(rows: DataFrame, n: Column, repos: Column, holders: Column) -> DataFrame:
        kinds = [_counted(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
        base = F.sha2(_joined(F.filter("found", lambda x: x["k"] < len(BASE))), 256).alias("base_sha256")
        return rows.select(F.col("id").alias(id_col), *kinds, base, _joined(F.col("found")).alias("spans"), (F.size("found") - n).cast("bigint").alias("n_live"), n.cast("bigint").alias("n_example"), repos.alias("max_repos"), holders.alias("max_owners"))

    zero = F.lit(0).cast("bigint")
    copied = F.size(F.filter("found", lambda x: F.array_contains("examples", F.xxhash64(x["secret"]))))
    return described(none, F.lit(0), zero, zero).unionByName(described(some, copied, F.col("max_repos"), F.col("max_owners")))


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with these spans, which are in order and may overlap, replaced by a mask."""

    def cut(b: Column) -> Column:
        def piece(lo: Column, hi: Column) -> Column:
            first = F.floor(lo / BLOCK).cast("int")
            blocks = F.slice(b["blocks"], first + 1, F.floor((hi - 1) / BLOCK).cast("int") - first + 1)
            return F.when(hi > lo, F.substring(F.array_join(blocks, ""), lo - first * BLOCK + 1, hi - lo)).otherwise("")

        def kept(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(b["to"], i - 1), F.lit(0))
            return F.when(x["start"] >= before, F.concat(piece(before, x["start"]), F.lit(mask))).otherwise("")

        return F.concat(F.array_join(F.transform(b["found"], kept), ""), piece(F.element_at(b["to"], -1), b["size"]))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    to = _running(F.transform(found, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    return _let(F.struct(blocks.alias("blocks"), to.alias("to"), found.alias("found"), F.length(text).alias("size")), cut)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str | Column = "source", owner: str | Column = "source", wide: int = WIDE, salts: int = SALTS, mask: str = MASK) -> DataFrame:
    """docs with the live-looking spans of their texts replaced by a mask; n_chars, if there, follows. Copied examples stay."""
    none, some = _judged_rows(docs, id_col, text_col, repo, owner, wide, salts, True)
    some = some.select("row", F.filter("found", lambda x: ~F.array_contains("examples", F.xxhash64(x["secret"]))).alias("live"))
    some = some.select("row", F.when(F.size("live") > 0, masked(F.col(f"row.`{text_col}`"), F.col("live"), mask)).otherwise(F.col(f"row.`{text_col}`")).alias("new"), (F.size("live") > 0).alias("changed"))
    columns = []
    for f in docs.schema.fields:
        x = F.col(f"row.`{f.name}`")
        if f.name == text_col:
            x = F.col("new")
        elif f.name == "n_chars":
            x = F.when(F.col("changed"), F.length("new").cast(f.dataType)).otherwise(x)
        columns.append(x.alias(f.name))
    return none.select("row.*").unionByName(some.select(*columns))
