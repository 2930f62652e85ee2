"""Changes of record shape: pairs, episodes, conversations, lists and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.matching import hashed, number_of
from corpusloom.operators.ranking import ordered, others


def to_pairs(df: DataFrame, key: str, query: str, positive: str, negatives: str, high: float = 1.0, low: float = 0.0) -> DataFrame:
    """(key, slot, sentence1, sentence2, score): the positive with a high score, each negative with a low one.

    Null texts give no pair; a null list has no element.
    """
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("slot"), F.col(positive).alias("sentence2"), F.lit(high).alias("score")))
    rest = F.transform(F.coalesce(negatives, F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).cast("bigint").alias("slot"), x.alias("sentence2"), F.lit(low).alias("score")))
    each = df.select(key, F.col(query).alias("sentence1"), F.explode(F.concat(first, rest)).alias("p"))
    return each.select(key, "p.slot", "sentence1", "p.sentence2", "p.score").where("sentence1 IS NOT NULL AND sentence2 IS NOT NULL")


def to_labelled(df: DataFrame, key: str, supports: str) -> DataFrame:
    """(key, label, text): a map from label to texts, one row a text."""
    return df.select(key, F.explode(supports).alias("label", "_t")).select(key, "label", F.explode("_t").alias("text"))


def supports(df: DataFrame, key: str, label: str, text: str, k: int, seed: int) -> DataFrame:
    """(label, texts): k texts of each label in seeded order (C8, prototypes)."""
    w = W.partitionBy(label).orderBy(hashed(seed, key), key)
    few = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return few.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))).alias("_l")).select(F.col(label).alias("label"), F.col("_l.t").alias("texts"))


def episodes(queries: DataFrame, pool: DataFrame, key: str, label: str, text: str, k: int, seed: int, ways: int) -> DataFrame:
    """(key, text, label, supports): each query with k texts of its own label and of ways - 1 others.

    The pools of k texts a label are drawn once and are a small table; the other labels follow
    one another from where the query's hash points, so a query is joined to ``ways`` labels
    and not to all.  No query is among its own supports: a pool text equal to it is taken
    out, and a label left without texts is no way.
    """
    pools = supports(pool, key, label, text, k + 1, seed).withColumnRenamed("label", "_l")
    pools = pools.withColumn("_no", (F.row_number().over(W.orderBy("_l")) - 1).cast("bigint"))
    n = pools.count()
    q = queries.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label).join(pools.select(F.col("_l").alias(label), "_no"), label)
    draw = F.explode(F.sequence(F.lit(-1), F.lit(max(-1, min(ways - 1, n - 1) - 1))))
    j = q.withColumn("_d", draw).withColumn("_no", F.when(F.col("_d") < 0, F.col("_no")).otherwise(others(F.col("_no"), number_of(hashed(seed, key)) + F.col("_d"), n))).join(pools, "_no")
    own = F.slice(F.filter("texts", lambda t: ~t.eqNullSafe(F.col(text))), 1, k)
    return j.withColumn("_t", own).where(F.size("_t") > 0).groupBy(key, text, label).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "_t")))).alias("supports"))


def multi_positive(df: DataFrame, key: str, group: str, text: str, k: int) -> DataFrame:
    """(key, query, positives): a text with the next k texts of its group in key order, around the end."""
    rows = df.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(key, group, text)
    n = ordered(rows, [group], [key], "_i").join(rows.groupBy(group).agg(F.count("*").alias("_n")), group)
    want = n.select(key, group, F.col(text).alias("query"), "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_d")).where(F.col("_d") < F.col("_n"))
    want = want.withColumn("_j", F.pmod(F.col("_i") + F.col("_d"), F.col("_n")))
    other = n.select(group, F.col("_i").alias("_j"), F.col(text).alias("_t"))
    return want.join(other, [group, "_j"]).groupBy(key, "query").agg(F.array_sort(F.collect_list(F.struct("_d", "_t"))).alias("_l")).select(key, "query", F.col("_l._t").alias("positives"))


def label_prefix(df: DataFrame, label: str, statements: dict[str, str], name: str = "statement") -> DataFrame:
    """Adds the statement of a label; labels without one give null (C4)."""
    table = F.create_map(*[F.lit(x) for kv in statements.items() for x in kv])
    return df.withColumn(name, F.try_element_at(table, F.col(label)))


def first_negatives(df: DataFrame, negatives: str, k: int) -> DataFrame:
    """Only the first k elements of the list."""
    return df.withColumn(negatives, F.slice(F.coalesce(negatives, F.array().cast("array<string>")), 1, k))


def to_ridge(df: DataFrame, strength: float) -> DataFrame:
    """An episode record as one of the ridge objective: the same supports, with the strength as a column."""
    return df.withColumn("objective", F.lit("ridge_classification")).withColumn("ridge_lambda", F.lit(float(strength)))


def with_prompts(df: DataFrame, prompts: list[str], text: str, batch: str, slot: str) -> DataFrame:
    """Every row under every prompt, whole batches at a time: batch, prompt number, slot is the order."""
    p = F.explode(F.array(*[F.struct(F.lit(i).alias("prompt"), F.lit(t).alias("t")) for i, t in enumerate(prompts)]))
    each = df.withColumn("_p", p)
    return each.withColumn(text, F.concat("_p.t", text)).withColumn("prompt", F.col("_p.prompt")).drop("_p").select(batch, "prompt", slot, *[c for c in df.columns if c not in (batch, slot)])


def _named(field: str):
    return lambda t: F.struct(F.lit(field).alias("field"), t.alias("text"))


def all_texts(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, field, text) of every text in scalar, list and map columns, non-empty ones."""
    kinds = dict(df.dtypes)
    parts = []
    for f in fields:
        k = kinds[f]
        if k == "string":
            values = F.array(f)
        elif k == "array<string>":
            values = F.col(f)
        elif k == "map<string,string>":
            values = F.map_values(f)
        elif k == "map<string,array<string>>":
            values = F.flatten(F.map_values(f))
        else:
            raise TypeError(f"{f} holds {k}")
        parts.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _named(f)))
    each = df.select(key, F.explode(F.concat(*parts)).alias("_p")).select(key, "_p.field", "_p.text")
    return each.where("text IS NOT NULL AND trim(text) != ''")


def roles(turns: DataFrame, conversation: str, turn: str, role: str, text: str, names: list[str]) -> DataFrame:
    """One row a conversation, one column a role with its last text (C11)."""
    return turns.groupBy(conversation).agg(*[F.max_by(F.when(F.col(role) == n, F.col(text)), F.when(F.col(role) == n, F.col(turn))).alias(n) for n in names])


def joined_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str, with_role: bool = False, most: int = 10_000) -> DataFrame:
    """(conversation, text): the texts in turn order, one a line.

    A conversation of more than ``most`` turns is an error and not cut.
    """
    line = F.concat_ws(": ", role, text) if with_role else F.col(text)
    g = turns.where(F.col(text).isNotNull()).groupBy(conversation).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("s")))).alias("_l"))
    checked = F.when(F.col("_n") <= most, F.array_join(F.col("_l.s"), "\n")).otherwise(F.raise_error(F.lit(f"a conversation has more than {most} turns")).cast("string"))
    return g.select(conversation, checked.alias("text"))


def from_inverted(df: DataFrame, key: str, index: str) -> DataFrame:
    """(key, text) of a map from token to its places; of two tokens in one place the later by name stays.

    Done inside the row, so a long text is one row all the way.
    """
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(places)
    alone = F.filter(ordered, lambda x, i: ~F.coalesce(F.get(ordered, i + 1)["p"] == x["p"], F.lit(False)))
    return df.select(key, F.array_join(F.transform(alone, lambda x: x["w"]), " ").alias("text"))


def json_field(x: Column | str, path: str) -> Column:
    """A field of a JSON text; invalid escapes are repaired first, then a pattern finds it, else null (C14)."""
    c = F.col(x) if isinstance(x, str) else x
    repaired = F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\")
    found = F.regexp_extract(c, f'"{path}"[ ]*:[ ]*"?([^",}}]*)"?', 1)
    return F.coalesce(F.get_json_object(c, f"$.{path}"), F.get_json_object(repaired, f"$.{path}"), F.nullif(found, F.lit("")))


def _repaired(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\")


def _spoken(c: Column) -> Column:
    """The trimmed texts of a list that aren't empty, with blanks between them."""
    return F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")


def json_text(x: Column | str) -> Column:
    """The texts of {"text": [{"text": ...}, ...]} in one, after repair of invalid escapes; other texts as they are, trimmed (C14)."""
    c = F.col(x) if isinstance(x, str) else x
    parts = F.from_json(_repaired(c), "text array<string>")["text"]
    return F.coalesce(F.when(parts.isNotNull(), _spoken(F.transform(parts, lambda p: F.get_json_object(p, "$.text")))), F.trim(c))


def json_answer(x: Column | str) -> Column:
    """Conditions and solutions of a list of tasks in one text (C14).

    A list that can't be read, repaired or not, is searched by patterns for conditions, then
    solutions, then first answers; where there is none the text itself stays, trimmed.
    """
    c = F.col(x) if isinstance(x, str) else x
    fixed = _repaired(c)
    items = F.from_json(fixed, "array<string>")
    solution = lambda p: F.when(F.get_json_object(p, "$.solution").startswith("{"), F.get_json_object(p, "$.solution.text")).otherwise(F.get_json_object(p, "$.solution"))
    listed = F.when(F.trim(fixed).startswith("[") & items.isNotNull(), _spoken(F.transform(items, lambda p: _spoken(F.array(F.get_json_object(p, "$.condition"), solution(p))))))
    string = r'"((?:\\.|[^"\\])*)"'
    plain = lambda v: F.coalesce(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>")[0], v)
    found = [F.regexp_extract_all(fixed, F.lit(f"(?s){before}{string}"), F.lit(1)) for before in (r'"condition"\s*:\s*', r'"solution"\s*:\s*\{\s*"text"\s*:\s*', r'"answers"\s*:\s*\[\s*')]
    matched = F.nullif(_spoken(F.transform(F.concat(*found), plain)), F.lit(""))
    return F.coalesce(listed, matched, F.trim(c))


def json_tags(x: Column | str) -> Column:
    """The tags of a JSON list, of one JSON value, or the text itself as the only tag; none for null and empty texts (C14)."""
    c = F.col(x) if isinstance(x, str) else x
    one = F.when(c.rlike(r'^\s*"'), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"))
    many = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(many, one, F.array(c)))


def active_labels(df: DataFrame, *columns: str) -> Column:
    """The names of the columns that hold 1 or true."""
    return F.array_compact(F.array(*[F.when(F.col(c).cast("int") == 1, F.lit(c)) for c in columns]))


def rescale(x: Column | str, low: float, high: float) -> Column:
    """A score from low..high to 0..1, clipped; null and NaN give null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low))))


#: Buckets with gaps: scores between them belong to none.
GAPPED = (("low", 0.0, 0.10), ("mid", 0.20, 0.70), ("high", 0.85, 0.95), ("top", 0.95, 1.0))


def bucket(x: Column | str, buckets: tuple[tuple[str, float, float], ...] = GAPPED) -> Column:
    """The bucket with low <= score < high, the last one with its end; scores in a gap, null and NaN give null (C17)."""
    c = F.col(x) if isinstance(x, str) else x
    last = buckets[-1][0]
    return reduce(lambda out, b: F.when((c >= b[1]) & ((c <= b[2]) if b[0] == last else (c < b[2])), b[0]).otherwise(out), reversed(buckets), F.lit(None).cast("string"))


def composite(*parts: Column | str, sep: str = "::") -> Column:
    """Parts of a label joined; null if one is."""
    return F.concat(*[p for i, x in enumerate(parts) for p in (([F.lit(sep)] if i else []) + [F.col(x) if isinstance(x, str) else x])])


def known_labels(x: Column | str, known: list[str]) -> Column:
    """The known labels in a list written with any separator, in the order of ``known``."""
    c = F.col(x) if isinstance(x, str) else x
    parts = F.split(F.lower(c), r"[+,|;/ \t]+")
    return F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.array_contains(parts, k))


def annotate(df: DataFrame, metadata: str, **values: Column) -> DataFrame:
    """Entries added to the metadata map; a new value replaces an old one (C20)."""
    new = F.create_map(*[p for k, v in values.items() for p in (F.lit(k), v.cast("string"))])
    old = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(values)))
    return df.withColumn(metadata, F.map_concat(kept, new))


def record_texts(df: DataFrame, key: str) -> DataFrame:
    """Number of texts of a contrastive record: query, positive, positives and negatives (C10, counts)."""
    return all_texts(df, key, "query", "positive", "positives", "negatives").groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def normalised_input(text: Column, query: Column, title: Column, body: Column) -> Column:
    """The text of an input: text, else query, else title and body together."""
    both = F.nullif(F.concat_ws(" ", title, body), F.lit(""))
    return F.coalesce(text, query, X.collapse(both))
