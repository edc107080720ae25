"""Line dedup by a log-template tree, in DataFrame functions only.

A line falls down trees of fixed depth: its number of tokens, then its first and second token in one tree, its first and last
in the other. Tokens with a digit are variable anywhere (`<*>`). What is left of the line is cut into FIELDS fields. In a leaf
that holds different lines, a line also stands for generalised templates: of SHORT tokens or more one of the fields may be a
variable, of LONG or more two of them, so that about half of a line's tokens at least are its template's own.

A template recurs if it occurs in MIN_DOCS texts or more that are no copies of each other. Copies are known by what else they say. A text
counts in full for a template if it has something of its own: OWN_WORDS words or more in lines that no other text holds, by any template or
edited; or if at least half of the characters of its other lines stand in such lines, however short. Otherwise it counts as one part in the number
of texts that hold its median line (lines by their characters, each with the texts that hold it by its commonest template or edited). So a group of near copies adds up to about one text, whatever its size,
and a text counts for a shared line however much else it shares. No hash decides about a template. A line of a text is edited if a text of its kin holds a
line with a mark of it: lines fall into pieces before words that begin with certain letters, and the KEPT least hashes of pieces are marks (of under LONG tokens: each token with its place); kin agree in one of KIN of their templates of MIN_DOCS texts or more, chosen by hashes among the commoner ones.

Blank lines are kept and never counted. Null texts stay null, empty texts empty; a document all of whose lines recur becomes an
empty text. Texts of any length are read whole. Ties have no meaning: every line of a recurring template goes. Repeated rows (same
id and text) and other exact copies count once and lose the same lines. Rows without an id take part, each with the lines of its
own text. An empty table gives an empty result. All columns are kept, whatever their names, with n_chars set anew if there.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, release, unused

FIELDS, SHORT, LONG, MIN_DOCS = 4, 4, 8, 5
OWN_WORDS, PIECE, KEPT, KIN = 4, 12, 4, 2
#: Where a line falls into pieces, by its own words: before about a quarter of the first letters of some scripts.
_CUT = " (?=[a-dA-DÀ-ÅÇà-åçα-εΑ-Εа-дА-Дא-ד])"
_VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def _marks() -> Column:
    """Hashes by which an edited line (line, n tokens) is known: the KEPT least ones of its pieces of PIECE characters or more; of under LONG tokens, each token with its place."""
    pieces = F.transform(F.filter(F.split("line", _CUT), lambda p: F.length(p) >= PIECE), lambda p: F.xxhash64(p))
    places = F.transform(F.split("line", " "), lambda x, i: F.xxhash64("n", i, x))
    return F.when(F.col("n") >= LONG, F.slice(F.array_sort(pieces), 1, KEPT)).otherwise(places)


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """copy (a hash of the text), total (characters of its lines), pos, size, exact, two leaves, masked line, number of tokens and marks of every line that is not blank."""
    clean = F.transform(F.split(text_col, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("copy"), clean.alias("lines"))
    summed = rows.select("copy", "lines", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("total"))
    # The outer form: for the inner one a filter on the array is inferred, which would be made again for it.
    each = summed.select("copy", "total", F.posexplode_outer("lines").alias("pos", "line")).where("line <> ''").withColumn("size", F.length("line"))
    wide = F.contains("line", F.lit("  ")) | F.contains("line", F.lit("\t")) | F.contains("line", F.lit("\r"))
    spaced = each.withColumn("line", F.when(wide, F.regexp_replace("line", "[ \t\r]+", " ")).otherwise(F.col("line")))
    masked = spaced.withColumn("line", F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _VARIABLE, "<*>")).otherwise(F.col("line")))
    sized = masked.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1)
    return sized.select(
        "copy", "total", "pos", "size", "n", "line", F.xxhash64("line").alias("exact"), _marks().alias("marks"),
        F.when(F.col("n") >= SHORT, F.xxhash64("n", F.substring_index("line", " ", 2))).alias("lead"),
        F.when(F.col("n") > SHORT, F.xxhash64(F.lit(0), "n", F.substring_index("line", " ", 1), F.substring_index("line", " ", -1))).alias("bound"),
    )


def _fields(lines: DataFrame) -> DataFrame:
    """lines with the field hashes m0 to m3, first (the second token and m0) and last (m3 and the last token) of those in a mixed leaf."""
    cut = lines.withColumn("t", F.when(F.col("lead_mixed") | F.col("bound_mixed"), F.split("line", " ")))
    step = F.greatest(F.ceil((F.col("n") - 3) / FIELDS).cast("int"), F.lit(0))
    field = [F.xxhash64(F.slice("t", F.lit(3) + step * i, F.greatest(F.least(step, F.col("n") - 3 - step * i), F.lit(0)))) for i in range(FIELDS)]
    hashed = cut.withColumns({f"m{i}": f for i, f in enumerate(field)})
    return hashed.withColumns({"first": F.xxhash64(F.get("t", F.lit(1)), "m0"), "last": F.xxhash64("m3", F.get("t", F.col("n") - 1))})


def _general(leaf: str, fields: list[str]) -> Column:
    """Keys of a line's generalised templates in one tree: all choices of one varying field, or of two."""

    def keys(vary: int) -> Column:
        kept = combinations(range(len(fields)), len(fields) - vary)
        return F.array(*[F.xxhash64(leaf, F.lit(vary), *(x for i in c for x in (F.lit(i), fields[i]))) for c in kept])

    return F.when(F.col("n") >= LONG, keys(2)).otherwise(keys(1))


def _keys(lines: DataFrame) -> DataFrame:
    """copy, total, pos, size, keys: a line's exact template, and the generalised ones in leaves that hold MIN_DOCS lines, not all the same."""
    fallen = lines.select(F.explode(F.array("lead", "bound")).alias("leaf"), "exact").where("leaf IS NOT NULL")
    mixed = fallen.groupBy("leaf").agg(F.count("*").alias("n"), F.min("exact").alias("lo"), F.max("exact").alias("hi")).where((F.col("n") >= MIN_DOCS) & (F.col("lo") != F.col("hi")))
    leaves = materialise(mixed.select("leaf"))
    at = lines
    for name in ("lead", "bound"):
        at = at.join(leaves.select(F.col("leaf").alias(name), F.lit(True).alias("is_mixed")), name, "left").withColumn(f"{name}_mixed", F.coalesce("is_mixed", F.lit(False))).drop("is_mixed")
    at, none = _fields(at), F.array().cast("array<long>")
    lead = F.when(F.col("lead_mixed"), _general("lead", ["m0", "m1", "m2", "last"])).otherwise(none)
    bound = F.when(F.col("bound_mixed"), _general("bound", ["first", "m1", "m2", "m3"])).otherwise(none)
    return at.select("copy", "total", "pos", "size", F.concat(F.array("exact"), lead, bound).alias("keys"))


def _known_lines(lines: DataFrame, shared: DataFrame, min_docs: int) -> DataFrame:
    """copy, pos, size, words, total, texts of every line of the texts that hold a template of min_docs texts or more: the texts that hold it by its commonest template, or edited among the text's kin; null if none else does."""
    most = shared.groupBy("copy").agg(F.max("texts").alias("most")).where(F.col("most") >= min_docs)
    # The least hash of those at least half as common as the text's commonest, and the commonest.
    by = [F.min(F.when(2 * F.col("texts") >= F.col("most"), F.xxhash64("key")))]
    kin = shared.where(F.col("texts") >= min_docs).join(most, "copy").groupBy("copy").agg(*[x.alias(f"k{j}") for j, x in enumerate([*by, F.max(F.struct("texts", "key"))["key"]])])
    held = shared.groupBy("copy", "pos").agg(F.max("texts").alias("texts"))
    # Copies of a text come with their lines each; what is told of them is the same.
    each = materialise(lines.select("copy", "pos", "size", "total", "n", "marks").join(kin, "copy").join(held, ["copy", "pos"], "left").select("copy", "pos", "size", "total", F.col("n").alias("words"), "texts", "marks", *(f"k{j}" for j in range(KIN))))
    keys = F.array(*[F.xxhash64("mark", F.lit(j), f"k{j}") for j in range(KIN)])
    told = materialise(each.select("copy", "pos", *(f"k{j}" for j in range(KIN)), F.explode("marks").alias("mark")).select("copy", "pos", F.explode(keys).alias("key")).distinct())
    common = told.select("copy", "key").distinct().groupBy("key").agg(F.count("*").alias("edited")).where("edited > 1")
    edited = told.join(materialise(common), "key").groupBy("copy", "pos").agg(F.max("edited").alias("edited"))
    once = each.groupBy("copy", "pos").agg(*[F.max(c).alias(c) for c in ("size", "total", "words", "texts")])
    return materialise(once.join(edited, ["copy", "pos"], "left").withColumn("texts", F.greatest("texts", "edited")).drop("edited"))


def _weights(known: DataFrame) -> DataFrame:
    """copy, total, own and words (characters and words in lines that no other text holds, not even edited), median (texts that hold its median line)."""
    mine = F.col("texts").isNull()
    sums = [F.max("total").alias("total"), F.sum(F.when(mine, F.col("size")).otherwise(0)).alias("own"), F.sum(F.when(mine, F.col("words")).otherwise(0)).alias("words")]
    text = known.groupBy("copy").agg(*sums, F.sort_array(F.collect_list(F.when(~mine, F.struct("texts", "size")))).alias("lines"))
    start = F.struct(F.col("own").cast("long").alias("seen"), F.lit(1).cast("long").alias("median"))
    found = F.aggregate("lines", start, lambda a, x: F.when(2 * a["seen"] >= F.col("total"), a).otherwise(F.struct((a["seen"] + x["size"]).alias("seen"), x["texts"].alias("median"))))
    return text.select("copy", "total", "own", "words", found["median"].alias("median"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text") -> DataFrame:
    """copy, drop: the positions of recurring lines by the hash of the text, for texts that have any."""
    lines = materialise(_lines(docs, text_col))
    keyed = _keys(lines).select("copy", "total", "pos", "size", F.explode_outer("keys").alias("key"))
    held = materialise(keyed.distinct())
    common = held.select("key", "copy").distinct().groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    # Written, so that a very common template can be dealt over tasks.
    shared = materialise(held.join(materialise(common), "key"))
    release(held)
    known = _known_lines(lines, shared, min_docs)
    release(lines)
    of_text = shared.groupBy("key", "copy").agg(F.sum("size").alias("taken")).join(_weights(known), "copy")
    full = (F.col("words") >= OWN_WORDS) | (2 * F.col("own") >= F.col("total") - F.col("taken"))
    part = F.when(full, 1.0).otherwise(1.0 / F.col("median"))
    recurring = of_text.groupBy("key").agg(F.sum(part).alias("n")).where(F.col("n") >= min_docs - 1e-6).select("key")
    return materialise(shared.join(materialise(recurring), "key", "left_semi").groupBy("copy").agg(F.collect_set("pos").alias("drop")))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with the recurring lines taken out of text_col; with counts also n_lines and n_dropped, in place of columns of these names."""
    key, drop, lines = unused(docs, "key", "drop", "lines")
    gone = recurring_lines(docs.select(text_col), min_docs, text_col).select(F.col("copy").alias(key), F.col("drop").alias(drop))
    joined = docs.withColumn(key, F.xxhash64(text_col)).join(gone.hint("merge"), key, "left").withColumn(lines, F.split(text_col, "\n", -1))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept)
    new = {text_col: text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    if counts:
        new |= {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_dropped": F.coalesce(F.size(drop), F.lit(0))}
    columns = [new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*columns, *(v.alias(k) for k, v in new.items() if k not in docs.columns))
