"""Matches between two collections of texts, and what is left without them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import arrow
from corpusloom.operators.ranking import in_blocks, numbered, ordered, others
from corpusloom.session import cut

#: Characters of the needles that are searched at once, at most: what is sent to the executors stays below 64 MB.
BLOCK_CHARS = 8_000_000


def exact(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All pairs of rows of two collections with the same key; null and empty keys match nothing."""
    return a.where(F.length(F.col(key).cast("string")) > 0).join(b, key)


def matched(a: DataFrame, b: DataFrame, row: str, key: str) -> DataFrame:
    """The rows of a with ``first``, the least row of b with the same key, and ``n``, how many b has (J1); no pair is formed."""
    groups = b.where(F.length(F.col(key).cast("string")) > 0).groupBy(key).agg(F.min(row).alias("first"), F.count("*").alias("n"))
    return a.join(groups, key)


def copies(df: DataFrame, row: str, key: str) -> DataFrame:
    """(row, first, n) of the rows whose key others have too: the least row with the key, and how many there are.

    The groups are aggregated before they are joined to the rows; their pairs are never formed.
    """
    some = df.where(F.length(F.col(key).cast("string")) > 0)
    groups = some.groupBy(key).agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
    return some.join(groups, key).select(row, "first", "n")


def digest(key: Column | str) -> Column:
    """128 bits that stand for a text in a join, so that texts aren't shuffled; null for null."""
    c = F.col(key) if isinstance(key, str) else key
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")))


def hit_by(df: DataFrame, row: str, keys: Column, wanted: DataFrame) -> DataFrame:
    """(row): the rows of which one of the keys is among those of ``wanted`` (key); keys meet as digests."""
    each = df.select(row, F.explode(F.transform(keys, digest)).alias("_d")).where("_d IS NOT NULL")
    return each.join(wanted.select(digest("key").alias("_d")).where("_d IS NOT NULL").distinct(), "_d", "left_semi").select(row).distinct()


def keys_of(df: DataFrame, *texts: Column | str) -> DataFrame:
    """(key): the different non-empty values of several text expressions."""
    each = F.array(*[F.col(t) if isinstance(t, str) else t for t in texts])
    return df.select(F.explode(each).alias("key")).where("key IS NOT NULL AND key != ''").distinct()


def decontaminate(df: DataFrame, row: str, fields: list[Column], keys: DataFrame, empty_is_bad: bool = True) -> DataFrame:
    """Rows of which no field's key is among ``keys`` (J3); rows without any key are dropped too, unless told otherwise.

    One shuffle of row ids and digests of keys, an aggregation to rows, and an anti join on the row id.
    """
    present = [F.when(f != "", f) for f in fields]
    out = df.join(hit_by(df, row, F.array(*present), keys), row, "left_anti")
    return out.where(F.size(F.array_compact(F.array(*present))) > 0) if empty_is_bad else out


def needles(x: Column | str, exact_least: int = 80, prefix: int = 220, title_least: int = 30) -> Column:
    """The keys by which a text is recognised: itself, its beginning, its title, each marked with its kind.

    The title is the raw text before the first full stop, normalised afterwards.
    """
    c = F.col(x) if isinstance(x, str) else x
    flat, title = X.audit_normal(c), X.audit_normal(F.substring_index(c, ".", 1))
    return F.array_compact(F.array(
        F.when(F.length(flat) >= exact_least, F.concat(F.lit("e:"), flat)),
        F.when(F.length(flat) >= prefix, F.concat(F.lit("p:"), F.substring(flat, 1, prefix))),
        F.when(F.length(title) >= title_least, F.concat(F.lit("t:"), title)),
    ))


def line_blocks(x: Column | str, lines: int | None = None, most: int = 4, least: int = 40) -> Column:
    """Normalised blocks of one to ``most`` lines that are long enough, among all lines or the first ``lines``.

    A line is normalised once: no pattern of the normal form reaches over a line's end.
    """
    c = F.col(x) if isinstance(x, str) else x
    rows = F.filter(F.split(c, "\n"), lambda s: F.trim(s) != "")
    normal = F.transform(rows if lines is None else F.slice(rows, 1, lines), lambda s: X.audit_normal(s))

    def blocks(r: Column) -> Column:
        n = F.size(r)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        made = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(i + k - 1 <= n, F.array_join(F.filter(F.slice(r, i, k), lambda s: s != ""), " ")))))
        return F.array_distinct(F.filter(made, lambda b: F.length(b) >= least))

    return _bound(normal, blocks)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a lambda computes what it takes from outside for every element."""
    return F.transform(F.array(x), lambda v: use(v))[0]


def beginnings(x: Column, words: int = 12, words_least: int = 8, chars: int = 180) -> Column:
    """Keys of the beginning of a normalised text: its first words, unless it has very few, and its first characters, if it has as many."""
    return F.array_compact(F.array(F.when(F.substring_index(x, " ", words_least - 1) != x, F.substring_index(x, " ", words)), F.when(F.length(x) >= chars, F.substring(x, 1, chars))))


def abstracts(x: Column | str, chars: int = 800) -> Column:
    """The normalised pieces of ``chars`` characters from every abstract marker, with the marker and without it."""
    c = F.col(x) if isinstance(x, str) else x
    found = F.regexp_extract_all(F.lower(c), F.lit(f"(?s)(?=((?:аннотация|abstract|резюме).{{0,{chars}}}))"), F.lit(1))
    without = lambda p: F.trim(F.regexp_replace(p, "^(?:аннотация|abstract|резюме)", ""))
    return _bound(F.transform(found, lambda p: X.audit_normal(p)), lambda pieces: F.concat(pieces, F.transform(pieces, without)))


def block_keys(x: Column | str, least: int = 40) -> Column:
    """The keys by which a document is found: its blocks of lines, and the beginnings of these and of what follows an abstract marker."""
    return _bound(line_blocks(x, least=least), lambda blocks: F.array_distinct(F.concat(blocks, F.flatten(F.transform(F.concat(blocks, abstracts(x)), lambda b: beginnings(b))))))


def passage_keys(x: Column | str, title_least: int = 30) -> Column:
    """The keys of a passage for ``block_keys``: itself, its beginnings and its title, as in ``needles``."""
    c = F.col(x) if isinstance(x, str) else x
    flat, title = X.audit_normal(c), X.audit_normal(F.substring_index(c, ".", 1))
    return F.array_distinct(F.array_compact(F.concat(F.array(F.when(flat != "", flat), F.when(F.length(title) >= title_least, title)), beginnings(flat))))


def containment(haystack: DataFrame, key: str, text: str, wanted: DataFrame, item: str, needle: str, least: int) -> DataFrame:
    """(key, item) where the text holds the needle, both being already normalised; equal texts are left out.

    The needles go through the executors in blocks as an Aho-Corasick automaton, and each
    block is one pass over the texts: exact, without a nested loop and without a shuffle.  Of
    several blocks each is worked off and written before the next is read.
    Null texts, and needles shorter than ``least``, match nothing.
    """
    spark = haystack.sparkSession
    types = dict(haystack.dtypes)[key], dict(wanted.dtypes)[item]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[types[1]]
    source = haystack.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    out, block, size = None, {}, 0

    def search(block: dict[str, list]) -> tuple[DataFrame, Broadcast]:
        a = ahocorasick.Automaton()
        for i, (n, ids) in enumerate(block.items()):
            a.add_word(n, (i, n, ids))
        a.make_automaton()
        sent = spark.sparkContext.broadcast(a)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, ids = [], []
                for r, t in enumerate(b.column(1).to_pylist()):
                    seen = set()
                    for _, (i, n, items) in sent.value.iter(t) if t else ():
                        if i not in seen and len(n) != len(t):
                            seen.add(i)
                            rows += [r] * len(items)
                            ids += items
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, arrow)], [key, item])

        return source.mapInArrow(scan, f"{key} {types[0]}, {item} {types[1]}"), sent

    for r in wanted.where(F.length(needle) >= least).select(item, needle).toLocalIterator():
        if size + len(r[needle]) > BLOCK_CHARS and block:
            out, block, size = one_by_one(out, *search(block)), {}, 0
        block.setdefault(r[needle], []).append(r[item])
        size += len(r[needle])
    if block:
        out = one_by_one(out, *search(block)) if out is not None else search(block)[0]
    return spark.createDataFrame([], f"{key} {types[0]}, {item} {types[1]}") if out is None else out


def one_by_one(done: DataFrame | None, part: DataFrame, sent: Broadcast) -> DataFrame:
    """The blocks done so far and one more, which is worked off and written now, so that what was sent for it can be dropped."""
    part = cut(part, "block")
    sent.destroy()
    return part if done is None else done.unionByName(part)


def contained(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """(a_id, b_id) where the text of a lies inside that of b, both being already normalised; equal texts are left out.

    a: (a_id, text), b: (b_id, text).  A text of a is found by the mark of its first ``least``
    characters among the marks of b (``arrow.anchors``), which are few for the length of b; so
    there are equi-joins on hashes only, whatever the number of texts on either side; that
    the whole text lies there is tested afterwards.  Null texts, and those of a shorter than
    ``least``, match nothing.
    """
    of, first = arrow.anchors(least), arrow.anchors(least, first=True)
    stretches = b.where(F.length("text") > least).select("b_id", F.explode(of("text")).alias("h"))
    longest = F.broadcast(b.agg(F.max(F.length("text")).alias("_longest")))  # one row
    starts = a.where(F.length("text") >= least).join(longest, F.length("text") < F.col("_longest")).select("a_id", F.explode(first("text")).alias("h"))
    pairs = starts.join(stretches, "h").select("a_id", "b_id").distinct()
    pairs = pairs.join(a.select("a_id", F.col("text").alias("a_text")), "a_id").join(b.select("b_id", F.col("text").alias("b_text")), "b_id")
    return pairs.where((F.length("b_text") > F.length("a_text")) & F.contains("b_text", "a_text")).select("a_id", "b_id").distinct()


def jaccard_pairs(a: DataFrame, b: DataFrame, at_least: float, least: int = 1) -> DataFrame:
    """(a_id, b_id, shared, sim) of all pairs of word sets with Jaccard similarity of at least ``at_least``.

    a: (a_id, words), b: (b_id, words).  Prefix filter: with the words of a set ordered from
    rare to common, two sets that are similar enough share a word among the first
    n - ceil(t n) + 1 of each.  So only rare words are joined, with the length of the set for
    the length bound; the sets themselves are fetched for the different candidates only.
    The similarity is exact, and no candidate is capped.  Sets of fewer than ``least`` words
    match nothing; of rows with the same id any may stand for it.
    """
    sets = [s.select(F.col(i).alias("id"), F.array_distinct("words").alias("words")).where(F.size("words") >= least) for s, i in ((a, "a_id"), (b, "b_id"))]
    often = sets[0].unionByName(sets[1]).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("f"))

    def prefixes(s: DataFrame, name: str) -> DataFrame:
        rare = s.select("id", F.size("words").alias("n"), F.explode("words").alias("w")).join(often, "w")
        ordered = rare.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"), F.first("n").alias("n"))
        length = (F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1).cast("int")
        return ordered.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), F.explode(F.transform(F.slice("o", F.lit(1), length), lambda x: x["w"])).alias("w"))

    left, right = prefixes(sets[0], "a"), prefixes(sets[1], "b")
    n, m = F.col("a_n"), F.col("b_n")
    pairs = left.join(right, "w").where((n >= m * at_least - 1e-9) & (m >= n * at_least - 1e-9)).select("a_id", "b_id").distinct()
    own = [s.select(F.col("id").alias(f"{x}_id"), F.col("words").alias(f"{x}_words")) for s, x in zip(sets, "ab", strict=True)]
    candidates = pairs.join(own[0], "a_id").join(own[1], "b_id")
    n, m = F.size("a_words"), F.size("b_words")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    sim = shared / (n + m - shared)
    return candidates.where(sim >= at_least - 1e-12).select("a_id", "b_id", shared.alias("shared"), sim.alias("sim")).distinct()


def refined(pairs: DataFrame, a: DataFrame, b: DataFrame, ratio: float = 92.0, letters: int = 4) -> DataFrame:
    """The pairs of ``jaccard_pairs`` that share a word of ``letters`` letters and whose texts agree in one of two ratios.

    a: (a_id, a_text), b: (b_id, b_text).  token_set_ratio: shared words and the rest of either
    side compared; partial_ratio: the shorter text against its best place in the longer.
    """
    both = pairs.join(a, "a_id").join(b, "b_id")
    long_words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= letters)
    both = both.where(F.arrays_overlap(long_words(F.col("a_text")), long_words(F.col("b_text"))))
    both = both.withColumn("token_set", arrow.token_set_ratio("a_text", "b_text")).withColumn("partial", arrow.partial_ratio("a_text", "b_text"))
    return both.where((F.col("token_set") >= ratio) | (F.col("partial") >= ratio)).drop("a_text", "b_text")


def without_flagged(df: DataFrame, flagged: DataFrame, *keys: str) -> DataFrame:
    """Rows that an audit didn't flag."""
    return df.join(flagged.select(*keys), list(keys), "left_anti")


def by_qrels(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Queries with their judged documents; judgements of missing ones are skipped."""
    return qrels.join(queries, query_id).join(corpus, doc_id)


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left lookup in a dimension; the optimizer broadcasts it if it is small."""
    return df.join(dimension, key, "left")


def contaminated_tasks(manifest: DataFrame, explicit: list[str] = ()) -> DataFrame:
    """(task, datasets): tasks that a used dataset contaminates, and those named explicitly.

    Datasets used for diagnosis only don't count; without a usage they do.
    """
    each = manifest.select(F.explode("datasets").alias("d")).where(~F.coalesce((F.size("d.usage") > 0) & (F.size(F.array_except("d.usage", F.array(F.lit("diagnostic_only")))) == 0), F.lit(False)))
    tasks = each.select(F.explode("d.contaminates_rumteb_tasks").alias("task"), F.col("d.id").alias("dataset"))
    if explicit:
        tasks = tasks.unionByName(manifest.sparkSession.createDataFrame([(t, "explicit") for t in explicit], "task string, dataset string"))
    return tasks.where("task IS NOT NULL").groupBy("task").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))


def compared(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """(key, left, right, delta) of the keys on both sides."""
    j = a.select(key, F.col(score).alias("left")).join(b.select(key, F.col(score).alias("right")), key)
    return j.withColumn("delta", F.col("left") - F.col("right"))


def hashed(seed: int | str, *keys: Column | str) -> Column:
    """The order of every seeded draw: an MD5 of seed and keys, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def number_of(hash_: Column) -> Column:
    """The first 32 bits of an MD5 as a number."""
    return F.conv(F.substring(hash_, 1, 8), 16, 10).cast("bigint")


def _pool(df: DataFrame, key: str, label: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(_l, _i, _k): the rows of each label numbered by hash, in hash ranges; (_l, _n): the sizes."""
    own = df.where(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_l")).withColumn("_h", hashed(seed, "_k")).withColumn("_b", F.substring("_h", 1, 2))
    return numbered(own, ["_l"], "_b", ["_h", "_k"], "_i").select("_l", "_i", "_k"), own.groupBy("_l").agg(F.count("*").alias("_n"))


def _numbered_labels(sizes: DataFrame) -> tuple[DataFrame, int]:
    """The labels, a small table, with their number by name, and how many there are."""
    return sizes.withColumn("_no", (F.row_number().over(W.orderBy("_l")) - 1).cast("bigint")), sizes.count()


def one_per_other_label(anchors: DataFrame, pool: DataFrame, key: str, label: str, seed: int, most: int = 8) -> DataFrame:
    """(key, other_label, other_key): for each anchor one row of each of ``most`` other labels.

    The labels follow one another from where the anchor's hash points, and of each the row to
    which another hash points; so there are equi-joins only, with ``most`` rows an anchor.
    Anchors of labels that the pool hasn't are left out.
    """
    rows, sizes = _pool(pool, key, label, seed)
    labels, n = _numbered_labels(sizes)
    if n < 2:
        return rows.limit(0).select(F.col("_k").alias(key), F.col("_l").alias("other_label"), F.col("_k").alias("other_key"))
    a = anchors.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_l")).join(labels.select("_l", "_no"), "_l").drop("_l")
    a = a.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(min(most, n - 1) - 1)))).withColumn("_no", others(F.col("_no"), number_of(hashed(seed, key)) + F.col("_d"), n))
    a = a.join(labels, "_no").withColumn("_i", F.pmod(number_of(hashed(seed, "_l", key)), F.col("_n")))
    return a.join(rows, ["_l", "_i"]).select(key, F.col("_l").alias("other_label"), F.col("_k").alias("other_key"))


def positional_pairs(df: DataFrame, key: str, group: str, shift: int) -> DataFrame:
    """(key, partner): the i-th row of a group with the (i + shift)-th, around the end; a row is never its own partner."""
    rows = df.where(F.col(group).isNotNull()).select(key, group)
    n = ordered(rows, [group], [key], "_i").join(rows.groupBy(group).agg(F.count("*").alias("_n")), group)
    right = n.select(F.col(key).alias("partner"), group, F.col("_i").alias("_j"))
    return n.withColumn("_j", F.pmod(F.col("_i") + shift, F.col("_n"))).join(right, [group, "_j"]).where(F.col(key) != F.col("partner")).select(key, group, "partner")


def label_statements(df: DataFrame, key: str, label: str, labels: DataFrame, form: str, seed: int, false_ones: int = 2) -> DataFrame:
    """(key, statement, target): the true label's statement with 1, and some false labels' with 0.

    labels: one column, a small dimension.  The false labels follow one another from where
    the row's hash points.  Rows whose label the dimension hasn't are left out.
    """
    dim, n = _numbered_labels(labels.toDF("_l").where("_l IS NOT NULL").distinct())
    own = df.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_l")).join(dim, "_l")
    true = own.select(key, "_l", F.lit(1).alias("target"))
    if n > 1:
        false = own.drop("_l").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(min(false_ones, n - 1) - 1)))).withColumn("_no", others(F.col("_no"), number_of(hashed(seed, key)) + F.col("_d"), n))
        true = true.unionByName(false.join(dim, "_no").select(key, "_l", F.lit(0).alias("target")))
    return true.select(key, F.format_string(form, "_l").alias("statement"), "target")


def sharing_labels(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(a, b, shared): pairs of rows, a < b, that share labels, through the labels and not by all pairs.

    The pairs are the result; those of one label are made in blocks, so a label that very many
    rows have is spread over tasks.
    """
    each = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(labels)).alias("_l")).where("_l IS NOT NULL")
    x, y, on = in_blocks(each.join(each.groupBy("_l").agg(F.count("*").alias("n")).where("n > 1"), "_l"), ["_l"])
    return x.join(y, on & (F.col("x_id") < F.col("y_id"))).groupBy(F.col("x_id").alias("a"), F.col("y_id").alias("b")).agg(F.count("*").alias("shared"))


def confusable_negatives(df: DataFrame, key: str, label: str, edges: DataFrame, seed: int, k: int = 1) -> DataFrame:
    """(key, negative): k rows of labels that the edge table calls confusable with the row's own; none for labels without edges.

    edges: (label, other).
    """
    rows, sizes = _pool(df, key, label, seed)
    want = df.select(key, label).join(edges, label).join(sizes.withColumnRenamed("_l", "other"), "other")
    want = want.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(hashed(seed, key, "other"), "other"))).where(F.col("_r") <= k)
    want = want.withColumn("_i", F.pmod(number_of(hashed(seed, "other", key)), F.col("_n"))).withColumnRenamed("other", "_l")
    return want.join(rows, ["_l", "_i"]).select(key, F.col("_k").alias("negative"))


def trigger_records(df: DataFrame, key: str, group: str, neutral: Column, per_group: int, positives: int, negatives: int, seed: int) -> DataFrame:
    """(group, i, query, positives, negatives): records of neutral rows against rows of the same trigger group.

    The i-th record of a group has its i-th neutral row as query, the next ``positives`` neutral
    rows of other groups, and as negatives rows that aren't neutral: all but two of the same
    group, the rest of other groups.  Pools are in seeded order and come again when used up;
    other groups take turns.  Groups without a neutral or without another row have no records.
    """
    rows = df.where(F.col(group).isNotNull()).select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.coalesce(neutral, F.lit(False)).alias("_e")).withColumn("_h", hashed(seed, "_k")).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy("_g").agg(F.count_if("_e").alias("_n"), F.count_if(~F.col("_e")).alias("_m")).where("_n > 0 AND _m > 0")
    sizes = sizes.withColumn("_no", (F.row_number().over(W.orderBy("_g")) - 1).cast("bigint"))
    many = sizes.count()
    pool = numbered(rows, ["_g", "_e"], "_b", ["_h", "_k"], "_at").select("_g", "_e", "_at", "_k").join(sizes.select("_g", "_no"), "_g")
    records = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1)))).withColumnRenamed("_no", "_own")

    def picks(role: str, n: int, same: bool, neutral_ones: bool, step: int) -> DataFrame | None:
        if n <= 0 or not same and many < 2:
            return None
        each = records.select(F.col("_g").alias("_group"), "_own", "i", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_j", "_x")).withColumn("_p", F.col("i").cast("bigint") * step + F.col("_j"))
        turn = many - 1
        each = each.withColumn("_no", F.col("_own") if same else others(F.col("_own"), F.pmod(F.col("_p"), F.lit(turn)), many)).withColumn("_p", F.col("_p") if same else F.floor(F.col("_p") / turn))
        each = each.join(sizes.select("_no", (F.col("_n") if neutral_ones else F.col("_m")).alias("_size")), "_no").withColumn("_at", F.pmod("_p", F.col("_size")))
        of = pool.where(F.col("_e") == neutral_ones).select("_no", "_at", "_k")
        return each.join(of, ["_no", "_at"]).select("_group", "i", F.lit(role).alias("_role"), F.lit(0 if same else 1).alias("_s"), "_j", "_k")

    parts = [picks("query", 1, True, True, 1), picks("positive", positives, False, True, positives), picks("negative", max(1, negatives - 2), True, False, negatives), picks("negative", min(2, negatives), False, False, negatives)]
    every = reduce(lambda a, b: a.unionByName(b), [p for p in parts if p is not None])
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("_role") == role, F.struct("_s", "_j", "_k")))), lambda x: x["_k"])
    g = every.groupBy("_group", "i").agg(F.max(F.when(F.col("_role") == "query", F.col("_k"))).alias("query"), of("positive").alias("positives"), of("negative").alias("negatives"))
    return g.withColumnRenamed("_group", group)


def verdict(exact_n: Column, contained_n: Column, lexical_n: Column) -> Column:
    """What an audit concludes, lexical near matches included."""
    return F.when(exact_n + contained_n > 0, "contaminated").when(lexical_n > 0, "near_duplicates").otherwise("clean")


def sampled_lexical(anchors: DataFrame, pool: DataFrame, key: str, label: str, words: str, seed: int, sample: int = 256, k: int = 1, same: bool = False) -> DataFrame:
    """(key, other, sim): of a seeded sample of each label's pool the k rows most similar in words.

    The sample is the feature: at most ``sample`` rows a label, drawn once and shared by all
    anchors, so the join is anchors times labels times sample and not all pairs.  For rows of
    other labels each anchor is given these by name first: an equi-join, whichever is asked.
    """
    own = pool.where(F.col(label).isNotNull() & F.col(words).isNotNull()).select(F.col(key).alias("other"), F.col(label).alias("_l"), F.col(words).alias("_w"))
    few = own.withColumn("_r", F.row_number().over(W.partitionBy("_l").orderBy(hashed(seed, "other"), "other"))).where(F.col("_r") <= sample).drop("_r")
    a = anchors.where(F.col(label).isNotNull() & F.col(words).isNotNull()).select(key, label, F.col(words).alias("_a"))
    if same:
        a = a.withColumn("_l", F.col(label))
    else:
        names, n = _numbered_labels(own.select("_l").distinct())
        a = a.withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))).join(names, "_no").where(F.col("_l") != F.col(label)).drop("_no")
    j = a.join(few, "_l").where(F.col(key) != F.col("other"))
    j = j.select(key, "other", X.jaccard("_a", "_w").alias("sim"))
    return j.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("sim"), "other"))).where(F.col("_r") <= k).drop("_r")
