"""Line dedup: exact copies and, by a deletion-neighbourhood join, lines that differ in one word.

The unit of an edit is a word: two lines are near copies if inserting, deleting or replacing one word makes them equal.
Each line's variants - itself and the line with any one word left out - are keyed by a 64-bit hash. A hash is the XOR of
a hash of (word, position) of each word, so every variant's key comes from running XORs of the line, whatever its length.
Lines with an equal variant are joined, their edit distance is verified on the words, and the earliest is kept.

Two lines within one edit agree in their first or in their last floor((n - 1) / 2) words, n being the larger length. Only
lines that share such an end with another one get variants; no pair is lost by that.

No key is joined with itself. Lines whose variants are equal *and* lack a word at the same place are all within one edit of
each other, so each meets the earliest of them alone; a line that is itself a variant's text meets every line with that
variant. That decides for every line whether any earlier line is within the bound, with one pair a variant.

The rule: a line of at least `exact_words` words or `exact_chars` characters goes if an equal line stands earlier in the
corpus (by doc_id, then line number); a line of at least `near_words` words also goes if an earlier line is within one edit. Lines are cut at
newlines; white space around them and its amount between words do not count. Blank and shorter lines stay. Equal lines
are known by two 64-bit hashes. Intermediates are deleted once they are used up; only the lines to take out of each
document stay in the shared folder, for the result reads them.

Defined results: null texts stay null; texts without lines to drop stay as they are; rows without an id come first;
rows that share an id follow in the order of a hash of their texts; rows that share an id and the text keep or lose
lines alike; an empty table gives no rows. All of this is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table

EXACT_WORDS, NEAR_WORDS = 5, 5
#: A line of fewer words, as in a script without spaces, counts for exact copies from so many characters on.
EXACT_CHARS = 10
SPACE = r"[ \t\x0B\f\r]+"


LINE = ["_h", "_g"]
#: How a table with one short row a key joins a larger one: its share of the keys is hashed in each task, and the larger side is not sorted.
UNIQUE = "shuffle_hash"


def _count(text: str, what: str) -> Column:
    """How often a one-byte string stands in a text: by bytes, which costs much less than by characters."""
    return (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(what), F.lit("")))).cast("int")


def _even(text: str) -> Column:
    """The text with single spaces. Most texts have nothing to replace, and looking is much cheaper; a whole text is looked at once, before it is cut."""
    uneven = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\x0b")])
    return F.when(uneven, F.regexp_replace(text, SPACE, " ")).otherwise(F.col(text))


def _hashes(text: str) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _lines(docs: DataFrame, key: str, text: str, exact: int, near: int, chars: int) -> DataFrame:
    """_id, _t (a hash of the whole text), _line and the two hashes of every line with at least `exact` words or `chars` characters, which have _exact, or `near` - 1 words; of one with `near` - 1 words also _ends, the hashes of its ends."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_t"), F.posexplode(F.split(_even(text), "\n", -1)).alias("_line", "_raw"))
    rows = rows.select("_id", "_t", "_line", F.trim("_raw").alias("_text"))
    rows = rows.withColumn("_n", _count("_text", " ") + 1).withColumn("_exact", (F.col("_n") >= exact) | (F.char_length("_text") >= chars)).where(F.col("_exact") | (F.col("_n") >= near - 1))

    # A line of n words meets lines of n - 1, n and n + 1: the ends are of floor((n - 1) / 2) words for the larger n.
    def sides(m: str) -> list[Column]:
        return [F.expr(f"xxhash64(0, {m}, substring_index(_text, ' ', {m}))"), F.expr(f"xxhash64(1, {m}, substring_index(_text, ' ', -{m}))")]

    low, high = sides("cast((_n - 1) div 2 AS int)"), sides("cast(_n div 2 AS int)")
    # Lines of near - 1 words only matter to those of one word more.
    ends = F.when(F.col("_n") < near, F.array(*high)).when(F.col("_n") % 2 == 1, F.array(*low)).otherwise(F.array(*low, *high))
    h, g = _hashes("_text")
    return rows.select("_id", "_t", "_line", "_exact", h.alias("_h"), g.alias("_g"), F.when(F.col("_n") >= max(near - 1, 1), ends).alias("_ends"))


def _asked(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """_h of the lines to look at: those that repeat, and, with _near, those that share an end with another line."""
    ends = lines.where("_ends IS NOT NULL").select("_h", F.explode("_ends").alias("_end"))
    shared = scratch.written(ends.groupBy("_end").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).where("_a <> _b").select("_end"))
    suspects = ends.join(shared.hint(UNIQUE), "_end", "left_semi").select("_h", F.lit(True).alias("_near"))
    repeated = lines.where("_exact").groupBy("_h").agg(F.count("*").alias("_c")).where("_c > 1").select("_h", F.lit(False).alias("_near"))
    # Written, so that the join with the lines reads both sides from shuffles and a hot line's places can be split.
    asked = scratch.written(repeated.unionByName(suspects).groupBy("_h").agg(F.max("_near").alias("_near")))
    scratch.drop(shared)
    return asked


def _texts(docs: DataFrame, key: str, text: str, firsts: DataFrame) -> DataFrame:
    """Hashes, _first and _w (words) of the lines of `firsts` that may have near copies. A line is read where it stands first, so no key is hot and each text moves once at most."""
    at = firsts.where("_near").groupBy(F.col("_first._id").alias("_fid"), F.col("_first._t").alias("_ft")).agg(F.collect_list(F.struct(F.col("_first._line").alias("_line"), *LINE)).alias("_wanted"))
    there = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_raw"))
    there = there.join(at.hint(UNIQUE), F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_t") == F.col("_ft")))
    cut = there.select("_id", "_t", "_wanted", F.split(_even("_raw"), "\n", -1).alias("_all"))
    rows = cut.select("_id", "_t", F.explode(F.transform("_wanted", lambda x: F.struct(x["_line"].alias("_line"), x["_h"].alias("_h"), x["_g"].alias("_g"), F.trim(F.get(F.col("_all"), x["_line"])).alias("_text")))).alias("x")).select("_id", "_t", "x.*")
    rows = rows.dropDuplicates(LINE)  # rows may repeat
    return rows.select(*LINE, F.struct("_id", "_t", "_line").alias("_first"), F.split("_text", " ").alias("_w"))


def _near(suspects: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """The hashes of the lines of at least `least` words that lie within one edit of an earlier one. suspects: hashes, _first (id, line) and _w (words)."""
    each = suspects.select(*LINE, F.posexplode("_w").alias("_i", "_word"))
    each = each.select(*LINE, "_i", F.xxhash64("_word", "_i").alias("_z"), F.xxhash64("_word", F.col("_i") - 1).alias("_y"))
    line = Window.partitionBy(*LINE)
    running = line.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    xor = F.expr("bit_xor(_z)"), F.expr("bit_xor(_y)")
    each = each.select(*LINE, "_i", "_z", xor[0].over(running).alias("_to_z"), xor[1].over(running).alias("_to_y"), xor[0].over(line).alias("_all_z"), xor[1].over(line).alias("_all_y"))
    without = F.struct(F.expr("_to_z ^ _z ^ _all_y ^ _to_y").alias("_v"), F.col("_i"))
    whole = F.struct(F.col("_all_z").alias("_v"), F.lit(-1).alias("_i"))
    every = each.select(*LINE, F.explode(F.when(F.col("_i") == 0, F.array(without, whole)).otherwise(F.array(without))).alias("_x"))
    every = scratch.written(every.select("_x._v", "_x._i", *LINE))
    # Nearly all variants are nobody else's; those go before anything is ordered or joined.
    common = every.groupBy("_v").agg(F.count("*").alias("_c")).where("_c > 1").select("_v")
    variants = scratch.written(every.join(common.hint(UNIQUE), "_v", "left_semi").join(suspects.select(*LINE, "_first"), LINE).select("_v", "_i", *LINE, "_first"))
    scratch.drop(every)

    me, other = F.struct("_first", *LINE), ["_oh", "_og"]
    hubs = variants.where("_i >= 0").groupBy("_v", "_i").agg(F.min(me).alias("_m"), F.count("*").alias("_c")).where("_c > 1")
    hubs = hubs.select("_v", "_i", F.col("_m._first").alias("_of"), F.col("_m._h").alias("_oh"), F.col("_m._g").alias("_og"))
    replaced = variants.join(hubs, ["_v", "_i"]).where("_of < _first").select(*LINE, *other)
    texts = variants.where("_i = -1").select("_v", F.col("_first").alias("_of"), F.col("_h").alias("_oh"), F.col("_g").alias("_og"))
    added = variants.where("_i >= 0").join(texts, "_v")
    late = F.col("_of") < F.col("_first")
    added = added.select(*[F.when(late, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("_h", "_oh", "_h"), ("_g", "_og", "_g"), ("_oh", "_h", "_oh"), ("_og", "_g", "_og"))])
    pairs = replaced.unionByName(added).distinct()
    theirs = suspects.select(F.col("_h").alias("_oh"), F.col("_g").alias("_og"), F.col("_w").alias("_ow"))
    verified = pairs.join(suspects.select(*LINE, "_w"), LINE).join(theirs, other).where((F.size("_w") >= least) & within_one("_w", "_ow"))
    near = scratch.written(verified.select(*LINE).distinct())
    scratch.drop(variants)
    return near


def within_one(a: str, b: str) -> Column:
    """Whether one word inserted, deleted or replaced (or nothing) makes two arrays of words equal."""
    same = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> NOT e)) <= 1")

    def shorter(s: str, t: str) -> Column:
        first = f"coalesce(array_position(zip_with({s}, slice({t}, 1, size({s})), (x, y) -> x = y), false), 0L)"
        at = f"cast(if({first} = 0, size({s}) + 1, {first}) AS int)"
        return F.expr(f"slice({s}, {at}, size({s}) + 1) = slice({t}, {at} + 1, size({t}) + 1)")

    return F.when(F.size(a) == F.size(b), same).when(F.size(a) + 1 == F.size(b), shorter(a, b)).when(F.size(b) + 1 == F.size(a), shorter(b, a)).otherwise(False)


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", exact_words: int = EXACT_WORDS, near_words: int = NEAR_WORDS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """docs with the lines that go taken out of `text`, n_lines, n_exact and n_near. Columns of docs of these names are replaced; columns _id, _t and _gone are not carried."""
    if near_words < exact_words or exact_words < 1:
        raise ValueError("need 1 <= exact_words <= near_words")
    if exact_chars < 1:
        raise ValueError("need 1 <= exact_chars")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near", "_gone", "_id", "_t")]
    scratch = Scratch(docs.sparkSession)
    lines = scratch.written(_lines(docs, key, text, exact_words, near_words, exact_chars))
    asked = _asked(lines, scratch)
    places = scratch.written(lines.select(*LINE, "_id", "_t", "_line", "_exact").join(asked.hint(UNIQUE), "_h"))
    scratch.drop(lines, asked)
    firsts = scratch.written(places.groupBy(*LINE).agg(F.min(F.struct("_id", "_t", "_line")).alias("_first"), F.max("_near").alias("_near"), F.max("_exact").alias("_exact"), F.count("*").alias("_c")))
    suspects = scratch.written(_texts(docs, key, text, firsts))
    near = _near(suspects, near_words, scratch)
    fate = firsts.drop("_near").join(near.withColumn("_near", F.lit(True)), LINE, "left").where("_c > 1 AND _exact OR _near")
    fate = scratch.written(fate.select(*LINE, "_first", F.coalesce("_near", F.lit(False)).alias("_near")))
    scratch.drop(firsts, suspects, near)
    marked = places.select(*LINE, "_id", "_t", "_line").join(fate, LINE)
    later = ~F.struct("_id", "_t", "_line").eqNullSafe(F.col("_first"))
    marked = marked.where(later | F.col("_near")).select("_id", "_t", "_line", later.alias("_later")).distinct()
    gone = scratch.written(marked.groupBy("_id", "_t").agg(F.collect_list("_line").alias("_gone"), F.count_if("_later").alias("n_exact"), F.count_if(~F.col("_later")).alias("n_near")))
    scratch.drop(places, fate)
    out = docs.select(*kept, F.col(key).alias("_id"), F.xxhash64(text).alias("_t")).alias("d").join(gone.alias("g").hint(UNIQUE), F.col("d._id").eqNullSafe(F.col("g._id")) & (F.col("d._t") == F.col("g._t")), "left")
    # The outer transform binds the split text once.
    rest = F.expr(f"transform(array(split({text}, '\\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]), '\\n'))[0]")
    cut = F.when(F.col("_gone").isNull() | F.col(text).isNull(), F.col(text)).otherwise(rest)
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(_count(text, "\n") + 1)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")]
    return out.select(*[cut.alias(c) if c == text else F.col(c) for c in kept], n_lines.cast("long").alias("n_lines"), *counts)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
