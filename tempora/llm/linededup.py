"""Lines that recur across documents, found as templates of a fixed-depth tree.

White space of any kind and length counts as one blank, and none at either end.
Each letter of a script without blanks is a token of its own; towards the length
of a line, four letters of other such scripts than Chinese are one.

A line is parsed down a tree: its number of tokens, then its first ``DEPTH``
tokens, digits masked, lead to a leaf.  Equal masked lines are one template.
Where a leaf holds several, the token that most of them share is taken at each
position and the rest are variable fields; templates that agree with it in at
least ``ALIKE`` of the positions become one generalised template.  What a leaf
holds besides goes one level down: alike lines agree in all of one block of
positions (pigeonhole), which keys a bucket, and what most templates of a bucket
share generalises them in the same way.  Generalised templates that have a
template in common are one, so a leaf holds any number of them.

A template that occurs in ``min_docs`` documents is dropped from all of them
but, with ``keep_first``, the one of the smallest id.  Lines of fewer than
``min_tokens`` tokens recur by chance: they are not generalised, and one template
of them has to occur in ``short_docs`` documents.  With ``short_docs`` None they
are left alone.

Results: a null text stays null, an empty one empty; a document is one id with
one text, so repeated rows are treated alike and all stay.  Only ``text`` (and
``n_chars`` where there is one) changes; other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.components import components
from tempora.sources.tables import remove_table, replace_table, scratch_dir

DEPTH = 3
# So many positions of so many.
ALIKE = (4, 5)
MIN_TOKENS = 8
SHORT_DOCS = 10
# Beyond plain blanks: control and Unicode white space, and what has no width.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}\x{200B}\x{2060}\x{FEFF}]"
SLOW = r"\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# Text of nothing else has neither, which one cheap pass tells; the classes are dear.
USUAL = r"\A[\n -~\u00A1-\u0DFF]*+\z"
# Whatever may be such white space or such a letter, in plain ranges: classes by property are slow.
ODD = r"[\x00-\x09\x0B-\x1F\x85\xA0\u0E00-\u0EFF\u1000-\u109F\u1680\u1780-\u17FF\u19E0-\u19FF\u2000-\u200B\u2028\u2029\u202F\u205F\u2060\u2E80-\u9FFF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFEFF\uFF65-\uFF9F\x{16FE0}-\x{3FFFF}]"
DOC = ["_id", "_tx"]
# Few tokens to a part of a file, which is one task's: each becomes a row.
BLOCK_BYTES = 4 << 20


def _lines(docs: DataFrame, min_tokens: int, short: bool) -> DataFrame:
    """Masked lines with their place in the tree."""
    # Looked for once a document: most have plain single blanks only.
    odd = (F.contains(F.col("text"), F.lit("  ")) | (~F.col("text").rlike(USUAL) & F.col("text").rlike(ODD))).alias("odd")
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tx"), "text", odd)
    keyed = keyed.select(*DOC, "odd", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    apart = F.regexp_replace("raw", rf"([\p{{IsHan}}{SLOW}])", " $1 ")
    bare = F.trim(F.when(F.col("odd"), F.regexp_replace(apart, f"{SPACE}+", " ")).otherwise(F.col("raw")))
    # Masking changes no blank, so tokens are counted, and lines left out, without it.
    n = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "))) + 1
    slow = F.when(F.col("odd"), F.length(F.regexp_replace(bare, f"[^{SLOW}]", ""))).otherwise(0)
    size = n - slow + F.ceil(slow / 4)
    # Replacing is dear beside looking: most lines have no digit.
    mask = F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, "[0-9]+", "0")).otherwise(bare)
    sized = keyed.where(bare != "" if short else size >= min_tokens).select(*DOC, "line", n.alias("n"), (size < min_tokens).alias("short"), mask.alias("masked"))
    leaf = F.xxhash64("n", F.substring_index("masked", " ", DEPTH))
    return sized.select(*DOC, "line", "n", "short", leaf.alias("leaf"), F.xxhash64("masked").alias("t1"), F.xxhash64(F.lit(1), "masked").alias("t2"), "masked")


def _alike(a: str, b: str) -> Column:
    """Lines of ``n`` tokens agree in at least ``ALIKE`` of the positions."""
    same, of = ALIKE
    return of * F.size(F.array_intersect(a, b)) >= same * F.col("n")


def _patterns(rows: DataFrame, key: str) -> DataFrame:
    """``key, pattern``: the tokens that more than half of a key's templates share, at most one a position."""
    held = rows.groupBy(key).agg(F.count("*").alias("m"))
    shares = rows.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("c"))
    return shares.where("c > 1").join(held, key).where("2 * c > m").groupBy(key).agg(F.collect_list("token").alias("pattern"))


def _texts(docs: DataFrame, templates: DataFrame, several: DataFrame, min_tokens: int, short: bool) -> DataFrame:
    """Masked lines of one document for each template of the leaves ``several``; others are not parsed again."""
    wanted = templates.join(several, "leaf").where("not short").select(F.col("lo").alias("_doc")).distinct()
    of = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.xxhash64("text")).alias("_doc"))
    return _lines(of.join(wanted.hint("shuffle_hash"), "_doc", "left_semi"), min_tokens, short).where("not short")


def _generalised(wanted: DataFrame, texts: DataFrame, scratch: str) -> DataFrame:
    """``t1, t2, leaf`` of templates that belong to a generalised one, which ``leaf`` names.

    ``wanted`` are the templates of leaves that hold several; no other text is kept.
    """
    # A template's text is looked for in one document only, and so is spread by it: a leaf may hold much.
    lines = texts.select(F.xxhash64(*DOC).alias("lo"), "t1", "t2", "leaf", "n", "masked")
    own = ["lo", "t1", "t2"]
    found = lines.join(wanted.select(*own).hint("shuffle_hash"), own).groupBy(*own, "leaf", "n").agg(F.first("masked").alias("masked"))
    # A token and its place are one number, so positions that agree are an intersection.
    tokens = F.transform(F.split("masked", " "), lambda x, i: F.xxhash64(i, x))
    found = replace_table(found.select("t1", "t2", "leaf", "n", tokens.alias("tokens")), f"{scratch}/found", **{"parquet.block.size": BLOCK_BYTES})
    patterns = replace_table(_patterns(found, "leaf"), f"{scratch}/patterns")
    major = F.coalesce(_alike("tokens", "pattern"), F.lit(False)).alias("major")
    judged = replace_table(found.join(patterns, "leaf", "left").select("t1", "t2", "leaf", "n", "tokens", major), f"{scratch}/judged")
    alike, rest = judged.where("major").select("t1", "t2", "leaf"), judged.where("not major")
    blocks = rest.select("t1", "n", F.explode(_blocks()).alias("bucket"))
    members = blocks.join(replace_table(_buckets(blocks), f"{scratch}/buckets"), "bucket")
    members = replace_table(members, f"{scratch}/members")
    if members.isEmpty():
        return alike
    shared = rest.join(members.select("t1").distinct(), "t1", "left_semi")
    links = _links(members, replace_table(_sets(shared), f"{scratch}/sets"))
    named = components(links).select(F.col("id").alias("t1"), "component")
    return alike.unionAll(rest.join(named, "t1").select("t1", "t2", F.col("component").alias("leaf")))


def _holders() -> list[Column]:
    """How many templates, and which: as good as their set."""
    return [F.count("*").alias("m"), F.bit_xor("t1").alias("x"), F.bit_xor(F.xxhash64("t1")).alias("y")]


def _buckets(members: DataFrame) -> DataFrame:
    """``bucket, m``: one of those that hold the same ``m`` templates, several, as each would link them alike.

    Two long lines share a bucket for every block they agree in.
    """
    held = members.groupBy("bucket").agg(*_holders()).where("m > 1")
    return held.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "m")


def _sets(lines: DataFrame) -> DataFrame:
    """``t1, n, set, k, w``: instead of a template's tokens, the sets of ``k`` templates of its leaf that hold ``w`` of them.

    Tokens of one set are in the same patterns, and a token that no other template holds is in none.
    """
    tokens = lines.select("leaf", "t1", "n", F.explode("tokens").alias("token"))
    holders = tokens.groupBy("leaf", "token").agg(*_holders()).where("m > 1")
    held = tokens.join(holders, ["leaf", "token"])
    return held.groupBy("t1", "n", F.xxhash64("leaf", "m", "x", "y").alias("set"), F.col("m").alias("k")).agg(F.count("*").alias("w"))


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: a bucket, and a template that agrees with what most templates of the bucket share."""
    enough = F.lit(ALIKE[1]) * F.sum("w") >= F.lit(ALIKE[0]) * F.col("n")
    # Only such can agree with a pattern; a bucket that holds none links nothing.
    able = sets.groupBy("t1", "n").agg(enough.alias("able")).where("able").select("t1")
    hopeful = members.join(members.join(able, "t1").select("bucket").distinct(), "bucket")
    held = hopeful.join(sets.drop("n"), "t1").where("2 * k > m")
    most = held.groupBy("bucket", "m", "set").agg(F.count("*").alias("c")).where("c > 1 and 2 * c > m").select("bucket", "set")
    agreed = held.join(most, ["bucket", "set"]).groupBy("bucket", "t1", "n").agg(enough.alias("enough")).where("enough")
    return agreed.select(F.col("bucket").alias("a"), F.col("t1").alias("b"))


def _blocks() -> Column:
    """A key for each of as many blocks of the positions after the leaf's own as alike lines may differ in, and one more."""
    same, of = ALIKE
    count = F.floor((of - same) * F.col("n") / of).cast("int") + 1

    def cut(i: Column) -> Column:
        return DEPTH + F.floor(i * F.greatest(F.col("n") - DEPTH, F.lit(1)) / count).cast("int")

    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64("leaf", i, F.slice("tokens", cut(i) + 1, cut(i + 1) - cut(i))))


def _groups(lines: DataFrame, docs: DataFrame, min_tokens: int, short: bool, scratch: str) -> DataFrame:
    """``t1, t2, g1, g2``: the groups, of one template or generalised, that lie in several documents."""
    doc = F.xxhash64(*DOC)
    templates = lines.groupBy("leaf", "t1", "t2", "short").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    templates = replace_table(templates, f"{scratch}/templates")
    several = templates.where("not short").groupBy("leaf").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a <> b")
    # Written first: a join of two plain shuffles can split a leaf that holds much.
    several = replace_table(several.select("leaf"), f"{scratch}/several")
    wanted = templates.where("not short").join(several, "leaf").select("leaf", "t1", "t2", "short", "lo")
    wanted = replace_table(wanted, f"{scratch}/wanted")
    texts = _texts(docs, wanted, several, min_tokens, short)
    alike = replace_table(_generalised(wanted, texts, scratch), f"{scratch}/alike")
    many = templates.select("t1", "t2", "lo", "hi").join(alike.withColumnRenamed("leaf", "g1"), ["t1", "t2"])
    many = replace_table(many, f"{scratch}/many")
    spread = many.groupBy("g1").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("g1")
    generalised = many.join(spread, "g1").select("t1", "t2", "g1", F.lit(0).cast("long").alias("g2"))
    single = templates.where("lo <> hi").join(alike, ["t1", "t2"], "left_anti")
    return generalised.unionAll(single.select("t1", "t2", F.col("t1").alias("g1"), F.col("t2").alias("g2")))


def recurring_lines(docs: DataFrame, min_docs: int = 2, min_tokens: int = MIN_TOKENS, keep_first: bool = True, short_docs: int | None = SHORT_DOCS) -> DataFrame:
    """``_id, _tx, lines``: the numbers, from 0, of the lines to drop."""
    spark, scratch = docs.sparkSession, scratch_dir(docs.sparkSession)
    short = short_docs is not None
    lines = replace_table(_lines(docs, min_tokens, short).drop("masked"), f"{scratch}/lines")
    groups = replace_table(_groups(lines, docs, min_tokens, short, scratch), f"{scratch}/groups")
    per_doc = lines.join(groups, ["t1", "t2"]).groupBy("g1", "g2", "short", *DOC).agg(F.collect_list("line").alias("lines"))
    per_doc = replace_table(per_doc, f"{scratch}/per_doc")
    least = F.when(F.col("short"), max(min_docs, short_docs or 0)).otherwise(min_docs)
    spread = per_doc.groupBy("g1", "g2", "short").agg(F.count("*").alias("docs"), F.min(F.struct(*DOC)).alias("first")).where(F.col("docs") >= least)
    spread = replace_table(spread, f"{scratch}/recurring")
    dropped = per_doc.join(spread, ["g1", "g2", "short"])
    if keep_first:
        dropped = dropped.where(F.struct(*DOC) != F.col("first"))
    dropped = replace_table(dropped.groupBy(*DOC).agg(F.flatten(F.collect_list("lines")).alias("lines")), f"{scratch}-dropped")
    remove_table(spark, scratch)
    return dropped


def clean_lines(docs: DataFrame, min_docs: int = 2, min_tokens: int = MIN_TOKENS, keep_first: bool = True, short_docs: int | None = SHORT_DOCS) -> DataFrame:
    """The documents without their recurring lines, and ``_lines`` and ``_dropped``, their numbers."""
    drops = recurring_lines(docs, min_docs, min_tokens, keep_first, short_docs).select(
        F.col("_id").alias("_drop_id"), F.col("_tx").alias("_drop_tx"), F.col("lines").alias("_drop")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_row_tx"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_drop_id")) & (F.col("_row_tx") == F.col("_drop_tx"))
    # The texts need no sort to meet the numbers of a document's lines.
    joined = rows.join(drops.hint("shuffle_hash"), same, "left")
    parts = F.split("_row.text", "\n")
    rest = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_drop", i)), "\n")
    changed = F.col("_drop").isNotNull()
    own = {
        "text": F.when(changed, rest).otherwise(F.col("_row.text")),
        "n_chars": F.when(changed, F.length(rest)).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None,
    }
    kept = [own.get(c, F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    lines, dropped = F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size("_drop"), F.lit(0))
    return joined.select(*kept, lines.cast("long").alias("_lines"), dropped.cast("long").alias("_dropped"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, min_tokens: int = MIN_TOKENS, keep_first: bool = True, short_docs: int | None = SHORT_DOCS) -> DataFrame:
    """The documents without their recurring lines, and without those of which nothing is left."""
    out = clean_lines(docs, min_docs, min_tokens, keep_first, short_docs)
    return out.where((F.col("_dropped") == 0) | (F.trim("text") != "")).select(*[f"`{c}`" for c in docs.columns])
