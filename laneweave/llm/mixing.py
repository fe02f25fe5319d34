"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in a fixed order, form one stream of words, cut
into blocks of ``BLOCK_WORDS``. Targets are weights capped at a multiple of
the source's size, the excess reshared. The output is a sequence of slots in
shards of ``SHARD_SLOTS``; each slot takes one block.

* Each shard's slot counts by source are a multinomial draw with the quotas'
  shares: every slot of a shard draws a source, and the counts are kept as a
  table (:meth:`Mix.counts`). Free counts would stray from the targets and break
  the cap on repeats, so what a source drew beyond its quota, in its last shards,
  goes to the sources that drew less than theirs; all other counts stay as drawn.
* The counts decide which slots there are: a source's slots are numbered on from
  shard to shard.
* A source's i-th slot takes block ``perm(i mod blocks)`` of pass ``i div
  blocks``, with another pseudorandom permutation for each source and pass.
  So no block, and no document, is taken more than ``ceil(cap)`` times.
* Slots and blocks are joined by (source, block index).

Permutations are swap-or-not networks over [0, n) with an integer hash, so
that reruns, and other engines, agree.

Null and empty texts have size 0 and are taken 0 times; a null source is a
source of its own, the last. Repeated rows count on their own. An empty table
gives no rows. Ids are whole numbers or null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, staged

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
#: Rows of a bucket, about, within which word offsets are summed.
BUCKET_ROWS = 4096
#: Slots, about, that one task takes at least.
CHUNK_SLOTS = 8192
#: Shards, about, that one task draws at least, and those within which slot numbers are summed.
DRAW_SHARDS, STRETCH_SHARDS = 16, 1024
ROUNDS = 12
PRIME = 2147483647
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- permutations


def _hash(value: Column, key: Column) -> Column:
    """A whole number below PRIME; all steps stay within 63 bits."""
    one = (value % PRIME * 48271 + key) % PRIME
    return (one * (one + 16807) % PRIME * 69621 + 12345) % PRIME


def turns(n: Column, seed: Column) -> Column:
    """Key and pivot of each round of a permutation of [0, n): what doesn't depend on the place, so that it is made once for many."""

    def one(r: Column) -> Column:
        key = (seed % PRIME * 16807 + r * 104729 + 77) % PRIME
        # below PRIME squared, then below n
        pivot = (_hash(F.lit(1), key) * PRIME + _hash(F.lit(2), key)) % n
        return F.struct(key.cast("long").alias("key"), pivot.cast("long").alias("pivot"))

    return F.transform(F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)]), one)


def permuted(x: Column, n: Column, rounds: Column, backwards: bool = False) -> Column:
    """Where a swap-or-not permutation of [0, n) sends x (or what it sends to x); ``rounds`` from :func:`turns`."""

    def swapped(at: Column, t: Column) -> Column:
        partner = (t["pivot"] + n - at) % n
        bit = F.shiftright(_hash(F.greatest(at, partner), t["key"]), 15) % 2
        return F.when(bit == 1, partner).otherwise(at)

    return F.aggregate(F.reverse(rounds) if backwards else rounds, x.cast("long"), swapped)


# ---------------------------------------------------------------- draws


def _ends(sources: DataFrame, end: Column) -> DataFrame:
    """One row: _one, ends (those of the sources' parts of a line, in source order)."""
    return sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("source_no", end.alias("end")))), lambda x: x["end"]).alias("ends")).withColumn("_one", F.lit(1))


def _place_in(number: Column, n: int) -> Column:
    """The source whose part of the line holds a number: how many of the ``n`` ends aren't above it, by halving."""
    steps = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(max(n, 1).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= n) & (F.get("ends", (at + step - 1).cast("int")) <= number), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0).cast("long"), further)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- plan


@dataclass
class Mix:
    """The parts of a mix. rows: one row for each document, with its place in its source's stream."""

    sources: DataFrame  # source_no, source, source_size, weight, target, blocks, quota, slots_before, slots
    rows: DataFrame  # doc_id, size, key, source_no, bucket, nth, first_word
    block_words: int

    def draws(self) -> DataFrame:
        """What each shard draws: shard, source_no, drawn (1 or more)."""
        spark = self.sources.sparkSession
        total, n_sources = self.sources.agg(F.coalesce(F.max("slots"), F.lit(0)), F.count("*")).first()
        shards = -(-total // SHARD_SLOTS)
        drawing = spark.range(0, shards, 1, max(1, min(_partitions(spark), shards // DRAW_SHARDS))).select(F.col("id").alias("shard"))
        begin = F.col("shard") * SHARD_SLOTS
        slot = drawing.withColumn("place", F.explode(F.sequence(begin, F.least(begin + SHARD_SLOTS, F.lit(total)) - 1)))
        key = F.expr(f"place div {PRIME}") * 16807 + 5
        number = (_hash(F.col("place"), key) * PRIME + _hash(F.col("place"), key + 7919)) % total if total else F.lit(0)
        ends = _ends(self.sources, F.col("slots_before") + F.col("quota"))
        found = slot.withColumn("number", number).withColumn("_one", F.lit(1)).join(ends, "_one")
        return found.select("shard", _place_in(F.col("number"), n_sources).alias("source_no")).groupBy("shard", "source_no").agg(F.count("*").alias("drawn"))

    def counts(self) -> DataFrame:
        """Slots of shards by source: shard, source_no, first (number of the source's first one there), n. Sources' sums are their quotas."""
        drawn = staged(self.draws(), "mix-draws").withColumn("stretch", F.expr(f"shard div {STRETCH_SHARDS}"))
        # numbers of slots: sums of stretches before, then a running sum within the stretch
        sums = drawn.groupBy("source_no", "stretch").agg(F.sum("drawn").alias("stretch_drawn"))
        before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.withColumn("base", F.coalesce(F.sum("stretch_drawn").over(before), F.lit(0))).drop("stretch_drawn")
        within = Window.partitionBy("source_no", "stretch").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        rows = drawn.withColumn("inside", F.sum("drawn").over(within) - F.col("drawn")).join(bases, ["source_no", "stretch"])
        rows = rows.select("shard", "source_no", (F.col("base") + F.col("inside")).alias("first"), "drawn")
        # one row for each source from here
        earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
        all_drawn = sums.groupBy("source_no").agg(F.sum("stretch_drawn").alias("all_drawn"))
        over, under = F.greatest(F.col("all_drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("all_drawn"), F.lit(0))
        books = (
            self.sources.select("source_no", "quota")
            .join(all_drawn, "source_no", "left")
            .withColumn("all_drawn", F.coalesce("all_drawn", F.lit(0)))
            .withColumn("over_before", F.coalesce(F.sum(over).over(earlier), F.lit(0)))
            .withColumn("under_before", F.coalesce(F.sum(under).over(earlier), F.lit(0)))
            .withColumn("under", under)
        )
        books = staged(books, "mix-books")
        rows = rows.join(books.select("source_no", "quota", "over_before"), "source_no")
        last = F.col("first") + F.col("drawn")
        kept = rows.select("shard", "source_no", "first", (F.least(last, F.col("quota")) - F.col("first")).alias("n")).filter("n > 0")
        spare = rows.filter(last > F.col("quota")).withColumn("nth", F.explode(F.sequence(F.greatest("first", "quota"), last - 1)))
        spare = spare.select("shard", (F.col("over_before") + F.col("nth") - F.col("quota")).alias("number"), F.lit(1).alias("_one"))
        ends = _ends(books, F.col("under_before") + F.col("under"))
        given = spare.join(ends, "_one").select("shard", "number", _place_in(F.col("number"), books.count()).alias("source_no")).join(books, "source_no")
        given = given.select("shard", "source_no", (F.col("all_drawn") + F.col("number") - F.col("under_before")).alias("first"), F.lit(1).cast("long").alias("n"))
        return kept.union(given)

    def slots(self) -> DataFrame:
        """All output slots: shard, slot, source_no, pass_no, block."""
        sources = self.sources.filter(F.col("quota") > 0)
        total = sources.agg(F.max("slots")).first()[0] or 0
        in_shard = Window.partitionBy("shard").orderBy("source_no", "first").rowsBetween(Window.unboundedPreceding, 0)
        placed = self.counts().withColumn("place", F.sum("n").over(in_shard) - F.col("n")).withColumn("held", F.sum("n").over(Window.partitionBy("shard")))
        # a few bytes a row here, many slots after: a number of partitions of their own, which isn't coalesced
        spread = placed.repartition(max(1, min(_partitions(sources.sparkSession), total // CHUNK_SLOTS)), "shard", "source_no")
        runs = spread.join(sources.select("source_no", "blocks"), "source_no")
        runs = runs.withColumn("pass_no", F.explode(F.expr("sequence(first div blocks, (first + n - 1) div blocks)")))
        begin = F.greatest(F.col("first"), F.col("pass_no") * F.col("blocks"))
        end = F.least(F.col("first") + F.col("n"), (F.col("pass_no") + 1) * F.col("blocks"))
        order = turns(F.col("blocks"), F.col("source_no") * 1009 + F.col("pass_no") + 2)
        runs = runs.withColumn("order", order).withColumn("deal", turns(F.col("held"), F.col("shard") + 1))
        one = runs.withColumn("i", F.explode(F.sequence(begin, end - 1)))
        return one.select(
            "shard",
            permuted(F.col("place") + F.col("i") - F.col("first"), F.col("held"), F.col("deal")).alias("slot"),
            "source_no",
            "pass_no",
            permuted(F.col("i") - F.col("pass_no") * F.col("blocks"), F.col("blocks"), F.col("order")).alias("block"),
        )

    def pieces(self) -> DataFrame:
        """The parts of documents in blocks: rows' columns, block, from_word (in the document), n_words. Documents without words have one row with null block."""
        b = self.block_words
        whole = F.when(F.col("size") > 0, F.sequence(F.expr(f"first_word div {b}"), F.expr(f"(first_word + size - 1) div {b}")))
        begin = F.greatest(F.col("first_word"), F.col("block") * b)
        end = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * b)
        return (
            self.rows.withColumn("block", F.explode_outer(whole))
            .withColumn("from_word", begin - F.col("first_word"))
            .withColumn("n_words", end - begin)
        )

    def taken(self) -> DataFrame:
        """One row for each document: doc_id, size, source_no, taken (words that the mix takes, repeats counted), first_shard (the least shard with words of it, null without)."""
        uses = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("uses"), F.min("shard").alias("first_shard"))
        joined = self.pieces().join(uses, ["source_no", "block"], "left")
        words = F.coalesce(F.sum(F.col("n_words") * F.col("uses")), F.lit(0)).cast("long")
        return joined.groupBy("source_no", "bucket", "nth", "doc_id", "size").agg(words.alias("taken"), F.min("first_shard").alias("first_shard")).drop("bucket", "nth")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each source's target: its share by weight of all sizes, at most ``cap`` times its size, the excess reshared.

    Sources stand in code point order, null last; weights repeat. The level at
    which weight times level, capped, adds up to all sizes is found with running
    sums over the sources in the order in which they reach their caps. The
    windows see one row for each source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("source_size") * cap / F.col("weight")), "source_no")
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(w) for w in weights])
    out = (
        sizes.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("source_no", (F.row_number().over(every) - 1).cast("long"))
        .withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("capped")) / F.col("weights_left"))
        .withColumn("holds", F.when(F.col("level") <= F.col("source_size") * cap / F.col("weight"), F.struct("place", "level")))
        .withColumn("level", F.min("holds").over(whole)["level"])
        .withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight")))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
        .withColumn("slots_before", F.coalesce(F.sum("quota").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("slots", F.sum("quota").over(whole))
    )
    return out.select("source_no", "source", "source_size", "weight", "target", "blocks", "quota", "slots_before", "slots")


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
) -> Mix:
    """The mix of all documents. ``key``: a value of the document row that ``rows`` carries along."""
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size_of(F.col(text_col)).alias("size"),
        (F.lit(None).cast("long") if key is None else key).alias("key"),
    )
    sizes = staged(sizes, "mix-sizes")
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    sources = staged(targets(sizes, weights, cap, block_words), "mix-sources")
    hashed = F.pmod(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(PRIME)) * 48271 % PRIME % buckets
    numbered = _numbered(sizes, sources, hashed)
    # word offsets: sums of buckets before, then a running sum within the bucket, so that a large source is many groups
    sums = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy("source_no", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "key")
    rows = (
        numbered.withColumn("nth", F.row_number().over(within))
        .withColumn("inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(bases, ["source_no", "bucket"])
        .withColumn("first_word", F.col("base") + F.col("inside"))
        .select("doc_id", "size", "key", "source_no", "bucket", "nth", "first_word")
    )
    return Mix(sources, staged(rows, "mix-rows"), block_words)


def _numbered(sizes: DataFrame, sources: DataFrame, bucket: Column) -> DataFrame:
    """Sizes with source_no and bucket; the source table's size decides how Spark joins."""
    names = sources.select("source_no", F.col("source").alias("_name"))
    return sizes.join(names, F.col("source").eqNullSafe(F.col("_name"))).select("doc_id", "size", "key", "source_no", bucket.alias("bucket"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as documents: for each pass over its source in which a document is taken, a row with the words taken.

    A pass that takes all of a document gives its text as it is; else the words
    taken are joined by spaces. Other columns stay; ``length_col`` (if there is
    such a column) becomes the text's length.
    """
    columns = docs.columns
    key = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])  # rows with equal keys are copies
    mix = plan(docs, id_col, text_col, source_col, key)
    parts = mix.slots().join(mix.pieces().filter(F.col("block").isNotNull()), ["source_no", "block"])
    runs = parts.groupBy("key", "source_no", "bucket", "nth", "pass_no", "size").agg(
        F.sum("n_words").alias("words"), F.collect_list(F.struct("from_word", "n_words")).alias("runs")  # as many as blocks in the document
    )
    own, whole, taken, split = (free_name(docs, n) for n in ("_key", "_whole", "_runs", "_words"))
    runs = runs.select(
        F.col("key").alias(own),
        (F.col("words") == F.col("size")).alias(whole),
        F.array_sort("runs").alias(taken),
    )
    once = docs.withColumn(own, key).dropDuplicates([own])
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(taken, lambda r: F.slice(F.col(split), (r["from_word"] + 1).cast("int"), r["n_words"].cast("int")))), " ")
    out = runs.join(once, own).withColumn(split, F.when(~F.col(whole), words))
    out = out.withColumn(text_col, F.when(F.col(whole), F.col(text_col)).otherwise(cut))
    if length_col in columns:
        out = out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return out.select(*columns)


def oracle_sql() -> str:
    """DuckDB SQL for op2: the same plan, permutation rounds as nested selects."""

    def hashed(value: str, key: str) -> str:
        one = f"((({value}) % {PRIME} * 48271 + ({key})) % {PRIME})"
        return f"({one} * ({one} + 16807) % {PRIME} * 69621 + 12345) % {PRIME}"

    rounds, at = [], "u0"
    for r in range(ROUNDS):
        rounds.append(
            f"k{r} AS (SELECT *, (seed % {PRIME} * 16807 + {r * 104729 + 77}) % {PRIME} AS k FROM {at}), "
            f"v{r} AS (SELECT *, ((({hashed('1', 'k')}) * {PRIME} + ({hashed('2', 'k')})) % n + n - x) % n AS p FROM k{r}), "
            f"u{r + 1} AS (SELECT source_no, shard, n, seed, CASE WHEN (({hashed('greatest(x, p)', 'k')}) // 32768) % 2 = 1 THEN p ELSE x END AS x FROM v{r})"
        )
        at = f"u{r + 1}"
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    b = BLOCK_WORDS
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
nb AS (SELECT greatest(1, count(*) // {BUCKET_ROWS}) AS buckets FROM d),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source),
s1 AS (SELECT *, CAST(CASE source_no % {len(WEIGHTS)} {weights} END AS BIGINT) AS weight FROM s0),
s2 AS (
  SELECT *, CAST(coalesce(sum(source_size * {CAP}) OVER (ORDER BY source_size * {CAP} / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    CAST(sum(weight) OVER (ORDER BY source_size * {CAP} / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights_left,
    row_number() OVER (ORDER BY source_size * {CAP} / weight, source_no) AS place, CAST(sum(source_size) OVER () AS BIGINT) AS everything FROM s1),
s3 AS (SELECT *, (everything - capped) / weights_left AS lvl FROM s2),
lv AS (SELECT arg_min(lvl, place) AS lvl FROM s3 WHERE lvl <= source_size * {CAP} / weight),
s4 AS (SELECT s3.* EXCLUDE (lvl), least(CAST(source_size * {CAP} AS DOUBLE), lv.lvl * weight) AS target, CAST(ceil(source_size / {b}) AS BIGINT) AS blocks FROM s3, lv),
s AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS quota FROM s4),
o AS (
  SELECT d.doc_id, d.size, s.source_no, s.source_size, s.target,
    CAST(sum(d.size) OVER (PARTITION BY s.source_no ORDER BY ((coalesce(doc_id, -1) % {PRIME} + {PRIME}) % {PRIME}) * 48271 % {PRIME} % buckets, doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS first_word,
    row_number() OVER () AS r
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, nb),
total AS (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS slots FROM s),
sb AS MATERIALIZED (SELECT *, CAST(sum(quota) OVER (ORDER BY source_no) - quota AS BIGINT) AS slots_before FROM s),
pl AS (SELECT unnest(range(0, (SELECT slots FROM total))) AS place),
pn AS MATERIALIZED (SELECT place, ({hashed('place', f'place // {PRIME} * 16807 + 5')}) * {PRIME} + ({hashed('place', f'place // {PRIME} * 16807 + 7924')}) AS number FROM pl),
dr AS MATERIALIZED (
  SELECT p // {SHARD_SLOTS} AS shard, source_no, quota, row_number() OVER (PARTITION BY source_no ORDER BY p) - 1 AS i
  FROM (SELECT place AS p, number % slots AS number FROM pn, total) JOIN sb ON slots_before <= number AND number < slots_before + quota),
ex AS (SELECT shard, row_number() OVER (ORDER BY source_no, i) AS e FROM dr WHERE i >= quota),
cn AS (SELECT source_no, count(*) AS drawn FROM dr GROUP BY source_no),
lk AS (
  SELECT source_no, unnest(range(drawn, quota)) AS i FROM (SELECT s.source_no, coalesce(drawn, 0) AS drawn, quota FROM s LEFT JOIN cn USING (source_no)) WHERE quota > drawn),
ln AS (SELECT *, row_number() OVER (ORDER BY source_no, i) AS e FROM lk),
sl AS MATERIALIZED (SELECT shard, source_no, i FROM dr WHERE i < quota UNION ALL SELECT shard, source_no, i FROM ex JOIN ln USING (e)),
u0 AS MATERIALIZED (
  SELECT source_no, shard, blocks AS n, source_no * 1009 + i // blocks + 2 AS seed, i % blocks AS x FROM sl JOIN s USING (source_no)),
{", ".join(rounds)},
uses AS (SELECT source_no, x AS block, count(*) AS uses, min(shard) AS first_shard FROM {at} GROUP BY source_no, x),
pieces AS (
  SELECT r, source_no, block, least(first_word + size, (block + 1) * {b}) - greatest(first_word, block * {b}) AS n_words
  FROM (SELECT *, unnest(range(first_word // {b}, (first_word + size - 1) // {b} + 1)) AS block FROM o WHERE size > 0)),
t AS (SELECT r, sum(n_words * uses) AS taken, min(first_shard) AS first_shard FROM pieces JOIN uses USING (source_no, block) GROUP BY r)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, CAST(t.first_shard AS BIGINT) AS first_shard FROM o LEFT JOIN t USING (r)
"""
