"""Chat examples: constructors, ChatML rendering, loss masks, message trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import pair_key, strip
from corpusloom.storage import checkpointed

#: Names and tags of languages in prompts, and the words around them.
NAMES = {"de": "German", "hsb": "Upper Sorbian", "dsb": "Lower Sorbian"}
TAGS = {"de": "deu", "hsb": "hsb", "dsb": "dsb"}
SYSTEM = "You are a professional translator. Translate the following text from {src} to {tgt}. Answer with the translated text."
#: Roles of other data sets.
ROLES = {"human": "user", "gpt": "assistant", "prompter": "user"}
#: Directions of the forward and of the reverse training set.
FORWARD = (("de", "hsb"), ("de", "dsb"), ("hsb", "dsb"), ("dsb", "hsb"))
REVERSE = (("hsb", "de"), ("dsb", "de"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def messages(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))])


def translation_chat(src: str = "src", tgt: str = "tgt", src_lang: str = "src_lang", tgt_lang: str = "tgt_lang", names: dict[str, str] = NAMES, system: str = SYSTEM) -> Column:
    """Messages of a translation example: the prompt names both languages (null if one has no name), both sides are stripped."""
    head, rest = system.split("{src}")
    middle, tail = rest.split("{tgt}")
    prompt = F.concat(F.lit(head), _lookup(names, F.col(src_lang)), F.lit(middle), _lookup(names, F.col(tgt_lang)), F.lit(tail))
    return messages(prompt, strip(F.col(src)), strip(F.col(tgt)))


def tagged_prompt(src: str = "src", src_lang: str = "src_lang", tgt_lang: str = "tgt_lang") -> Column:
    """A prompt that asks for the translation between tags."""
    a, b, x, y = _lookup(NAMES, F.col(src_lang)), _lookup(NAMES, F.col(tgt_lang)), _lookup(TAGS, F.col(src_lang)), _lookup(TAGS, F.col(tgt_lang))
    return F.concat(F.lit("Translate the following "), a, F.lit(" text to "), b, F.lit(". Put it in this format <"), y, F.lit("> "), b, F.lit(" translation </"), y, F.lit(">.\n<"), x, F.lit("> "), F.col(src), F.lit(" </"), x, F.lit(">"))


def tagged_answer(tgt: str = "tgt", tgt_lang: str = "tgt_lang") -> Column:
    tag = _lookup(TAGS, F.col(tgt_lang))
    return F.concat(F.lit("<"), tag, F.lit("> "), F.col(tgt), F.lit(" </"), tag, F.lit(">"))


def tagged_rows(pairs: DataFrame, system: str = "You are a helpful assistant.") -> DataFrame:
    """pairs (src, tgt, src_lang, tgt_lang) with conversations, a turn of each side, and system."""
    turns = F.array(F.struct(F.lit("human").alias("from"), tagged_prompt().alias("value")), F.struct(F.lit("gpt").alias("from"), tagged_answer().alias("value")))
    return pairs.withColumn("conversations", turns).withColumn("system", F.lit(system))


def rendered(m: Column, generation: bool = False) -> Column:
    """Known roles as <|im_start|>role, newline, content, <|im_end|>, newline; other roles emit nothing."""
    known = F.filter(m, lambda x: x["role"].isin("system", "user", "assistant"))
    out = F.array_join(F.transform(known, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>\n"))), "")
    return F.concat(out, F.lit("<|im_start|>assistant\n")) if generation else out


def chatml(m: str, generation: bool = False) -> Column:
    return rendered(F.col(m), generation)


def first_by_role(m: str, role: str) -> Column:
    """The first message of a role, stripped; null content and a missing message are empty."""
    return strip(F.coalesce(F.get(F.filter(F.col(m), lambda x: x["role"] == role), F.lit(0))["content"], F.lit("")))


def chat_key(m: str) -> Column:
    """The normalised user and assistant texts as a key; null if either is blank."""
    a, b = pair_key(first_by_role(m, "user")), pair_key(first_by_role(m, "assistant"))
    return F.when((a != "") & (b != ""), F.struct(a.alias("src"), b.alias("tgt")))


def canonical_roles(m: str, role: str = "role", content: str = "content") -> Column:
    """Messages as (role, content), roles of other data sets by their usual names, unknown ones as they are."""
    return F.transform(F.col(m), lambda x: F.struct(F.coalesce(_lookup(ROLES, x[role]), x[role]).alias("role"), x[content].alias("content")))


def with_messages(df: DataFrame) -> DataFrame:
    """df with messages from the first of the columns messages, conversations, inputs and targets that it has."""
    if "messages" in df.columns:
        return df
    if "conversations" in df.columns:
        fields = df.schema["conversations"].dataType.elementType.fieldNames()
        return df.withColumn("messages", canonical_roles("conversations", *(("from", "value") if "from" in fields else ("role", "content"))))
    if {"inputs", "targets"} <= set(df.columns):
        return df.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("inputs").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("targets").alias("content"))))
    raise ValueError(f"no messages in {df.columns}")


def directions(pairs: DataFrame) -> DataFrame:
    """German pairs go from German alone; others both ways."""
    one = F.struct(F.col("src_lang").alias("f"), F.col("tgt_lang").alias("t"), F.col("src").alias("a"), F.col("tgt").alias("b"))
    two = F.struct(F.col("tgt_lang").alias("f"), F.col("src_lang").alias("t"), F.col("tgt").alias("a"), F.col("src").alias("b"))
    ways = F.when(F.col("src_lang") == "de", F.array(one)).when(F.col("tgt_lang") == "de", F.array(two)).otherwise(F.array(one, two))
    kept = [c for c in pairs.columns if c not in ("src", "tgt", "src_lang", "tgt_lang")]
    return pairs.select(*kept, F.explode(ways).alias("d")).select(*kept, F.col("d.f").alias("src_lang"), F.col("d.t").alias("tgt_lang"), F.col("d.a").alias("src"), F.col("d.b").alias("tgt"))


def fanned_out(pairs: DataFrame, ways=FORWARD) -> DataFrame:
    """Pairs of two languages in each direction that `ways` names for them, whichever side they are given from."""
    kept = [c for c in pairs.columns if c not in ("src", "tgt", "src_lang", "tgt_lang")]
    both = F.array(*[F.struct(F.col(f"{x}_lang").alias("src_lang"), F.col(f"{y}_lang").alias("tgt_lang"), F.col(x).alias("src"), F.col(y).alias("tgt")) for x, y in (("src", "tgt"), ("tgt", "src"))])
    named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways])
    chosen = F.filter(both, lambda d: F.exists(named, lambda w: (w["a"] == d["src_lang"]) & (w["b"] == d["tgt_lang"])))
    return pairs.select(*kept, F.explode(chosen).alias("d")).select(*kept, "d.*")


def tree_paths(tree: DataFrame) -> DataFrame:
    """leaf, path (root first) of each leaf of a forest (id, parent). Paths that meet a missing parent or a circle are dropped. One join a level, each level written."""
    parents = tree.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    open_ = checkpointed(tree.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), F.array("id").alias("path"), F.col("parent").alias("up")))
    done = open_.where("up IS NULL").select("leaf", "path")
    up = tree.select(F.col("id").alias("up"), F.col("parent").alias("_p"))
    while not open_.where("up IS NOT NULL").isEmpty():
        open_ = open_.where("up IS NOT NULL AND NOT array_contains(path, up)").join(up, "up")
        open_ = checkpointed(open_.select("leaf", F.concat(F.array("up"), "path").alias("path"), F.col("_p").alias("up")))
        done = done.unionByName(open_.where("up IS NULL").select("leaf", "path"))
    return done


def conversations_of(paths: DataFrame, nodes: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """leaf, lang, messages of the paths (leaf, path of ids) that are valid: two messages or more, the first a user's, the last an assistant's, none
    deleted, and the root's language, as it is written, in `languages`. nodes: id, role, text, lang, deleted."""
    steps = paths.select("leaf", F.posexplode("path").alias("pos", "id")).join(nodes, "id")
    item = F.struct("pos", F.coalesce(_lookup(ROLES, F.col("role")), F.col("role")).alias("role"), F.col("text").alias("content"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    m = steps.groupBy("leaf").agg(F.array_sort(F.collect_list(item)).alias("m"))
    valid = (F.size("m") >= 2) & (F.col("m")[0]["role"] == "user") & (F.element_at("m", -1)["role"] == "assistant") & ~F.exists("m", lambda x: x["deleted"]) & F.col("m")[0]["lang"].isin(*languages)
    return m.where(valid).select("leaf", F.col("m")[0]["lang"].alias("lang"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def assistant_spans(m: str, tokenize, total: Column) -> Column:
    """Spans (begin, end) of the tokens that each assistant turn adds to the prompt before it, its end mark with it, cut at the total."""
    at = F.filter(F.sequence(F.lit(1), F.size(m)), lambda k: F.element_at(F.col(m), k)["role"] == "assistant")
    at = F.when(F.size(m) > 0, at).otherwise(F.array().cast("array<int>"))
    begin = lambda k: F.size(tokenize(rendered(F.slice(F.col(m), F.lit(1), k - 1), True)))
    end = lambda k: F.size(tokenize(rendered(F.slice(F.col(m), F.lit(1), k))))
    return F.transform(at, lambda k: F.struct(F.least(begin(k), total).alias("begin"), F.least(end(k), total).alias("end")))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def loss_mask(ids: Column, spans: Column) -> Column:
    covered = lambda i, all_: F.exists(all_, lambda s: (i >= s["begin"]) & (i < s["end"])).cast("tinyint")
    return bound(spans, lambda all_: F.transform(ids, lambda x, i: covered(i, all_)))


def masked(m: str, tokenize) -> Column:
    """(ids, loss_mask) of a conversation."""
    return bound(tokenize(chatml(m)), lambda ids: F.struct(ids.alias("ids"), loss_mask(ids, assistant_spans(m, tokenize, F.size(ids))).alias("loss_mask")))


def supervised(df: DataFrame, tokenize, m: str = "messages") -> DataFrame:
    """df with ids and loss_mask of each conversation; rows without messages, or without a token to learn, go."""
    kept = [c for c in df.columns if c not in ("ids", "loss_mask")]
    # The generator computes both once; a projection would be folded into each later use.
    rows = df.where(F.coalesce(F.size(m), F.lit(0)) > 0).select(*kept, F.explode(F.array(masked(m, tokenize))).alias("_x"))
    return rows.select(*kept, "_x.ids", "_x.loss_mask").where(F.array_contains("loss_mask", F.lit(1).cast("tinyint")))


def some(df: DataFrame, what: str = "examples") -> DataFrame:
    """df, which must have a row."""
    if df.isEmpty():
        raise ValueError(f"no {what} remain")
    return df


def each_group(groups: dict, make) -> tuple[dict, dict]:
    """(results, errors) of make(name, group) for every named group: one that fails does not stop the others."""
    done, failed = {}, {}
    for name, group in groups.items():
        try:
            done[name] = make(name, group)
        except Exception as e:
            failed[name] = str(e)
    return done, failed
