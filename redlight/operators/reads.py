"""Plate reads: filters, votes, consensus, canonical forms and duplicates."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plates as p
from ..storage import materialize, partitions
from .graph import components
from .masked import by_shared_places, equal_length


#: Reads that are this many seconds apart have the similarity of their texts alone.
APART = 5


def usable_reads(df: DataFrame, least: float = 0.3) -> DataFrame:
    return df.where(F.col("conf") > least).withColumn("text", F.regexp_replace(F.upper("text"), r"[^\p{L}0-9]", "")).where("text <> ''")


def not_blocked(df: DataFrame, blocked: list[str], col: str = "text") -> DataFrame:
    """Drops texts that hold a blocked one, whatever the spacing."""
    bare = F.regexp_replace(F.upper(col), "[ -]", "")
    for b in blocked:
        df = df.where(~bare.contains(b))
    return df


def second_pass(df: DataFrame, key: str = "crop_id", least: float = 0.5, few: int = 2) -> DataFrame:
    """``pass`` 1 rows, and pass 2 rows of crops that need them (no pass-1 read, or the best
    below ``least``); ``relax`` where fewer than ``few`` reads remain."""
    w = Window.partitionBy(key)
    best = F.max(F.when(F.col("pass") == 1, F.col("adj"))).over(w)
    kept = df.withColumn("_needs", best.isNull() | (best < least)).where((F.col("pass") == 1) | F.col("_needs")).drop("_needs")
    return kept.withColumn("relax", F.count("*").over(w) < few)


def first_usable(df: DataFrame, sources: list[str], least: int = 4) -> DataFrame:
    """The first source column whose text has ``least`` characters."""
    return df.withColumn("text", F.coalesce(*(F.when(F.length(s) >= least, F.col(s)) for s in sources))).withColumn("source", F.coalesce(*(F.when(F.length(s) >= least, F.lit(s)) for s in sources)))


def majority_vote(df: DataFrame, key: str = "crop_id") -> DataFrame:
    """Most frequent text of each group; of equals that of the earliest read."""
    counts = df.groupBy(key, "text").agg(F.count("*").alias("votes"), F.min("read_id").alias("first_id"))
    return counts.groupBy(key).agg(F.max_by(F.struct("text", "votes"), F.struct("votes", -F.col("first_id"))).alias("b")).select(key, "b.*")


def _score() -> Column:
    """(0.5 n + 0.3 mean confidence + 0.2 mean coherence) x 1.8 if any format is valid."""
    return (0.5 * F.count("*") + 0.3 * F.avg("conf") + 0.2 * F.avg("_coherence")) * F.when(F.max("_valid"), 1.8).otherwise(1.0)


def _best_text() -> Column:
    return F.max_by("text", F.struct("_valid", "conf", -F.col("read_id")))


def _judged(df: DataFrame) -> DataFrame:
    """Each text's format and coherence, once."""
    return df.withColumns({"_valid": p.valid_format("text"), "_coherence": p.pattern_coherence("text")})


def group_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """``score`` of each group, its size and its earliest read."""
    return _judged(df).groupBy(*keys).agg(_score().alias("score"), F.count("*").alias("n"), F.min("read_id").alias("first_id"))


def representative(df: DataFrame, keys: list[str]) -> DataFrame:
    """Text of the most confident valid read, else of the most confident; ties: earliest."""
    return _judged(df).groupBy(*keys).agg(_best_text().alias("text"))


def _best_group(df: DataFrame, key: str, group: str) -> DataFrame:
    """The group of the highest score (of equals the earliest) and its representative: groups
    carry theirs along, so reads are scanned once."""
    scored = _judged(df).groupBy(key, group).agg(_score().alias("score"), F.min("read_id").alias("first_id"), _best_text().alias("text"))
    best = F.max_by(F.struct(group, "text"), F.struct(F.round("score", 9), -F.col("first_id")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def best_candidate(df: DataFrame, key: str = "crop_id") -> DataFrame:
    adj = p.adjusted_conf("conf", "text")
    return df.groupBy(key).agg(F.max_by("text", F.struct(F.round(adj, 9), -F.col("read_id"))).alias("text"), F.max(adj).alias("adj"))


def consensus_exact(df: DataFrame, key: str = "crop_id") -> DataFrame:
    """Groups of equal pattern; the best group (of equals the earliest) and its representative."""
    return _best_group(df.withColumn("pattern", p.pattern_key("text")), key, "pattern")


def consensus(df: DataFrame, key: str = "crop_id", most: int = 15, near: float = 0.7) -> DataFrame:
    """Like :func:`consensus_exact`, but a pattern joins the first group whose key is more
    similar than ``near``. Order matters, so each group's first ``most`` reads are folded."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("read_id"))).where(F.col("_rn") <= most)
    rows = ranked.withColumn("pattern", p.pattern_key("text"))
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("read_id", "pattern"))).alias("all"))
    none = F.array().cast("array<struct<id:bigint,key:string>>")

    def step(acc, x):
        exact = F.filter(acc, lambda k: k["key"] == x["pattern"])
        like = F.filter(acc, lambda k: p.pattern_similarity(x["pattern"], k["key"]) > near)
        found = F.coalesce(F.get(exact, F.lit(0))["key"], F.get(like, F.lit(0))["key"], x["pattern"])
        return F.array_append(acc, F.struct(x["read_id"].alias("id"), found.alias("key")))

    named = listed.select(key, F.explode(F.aggregate("all", none, step)).alias("k")).select(key, F.col("k.id").alias("read_id"), F.col("k.key").alias("group"))
    return _best_group(rows.join(named, [key, "read_id"]), key, "group").select(key, "text")


def best_plate_in_image(df: DataFrame, key: str = "camera", most: int = 3) -> DataFrame:
    """Of the ``most`` best reads: length / 8, x 1.5 if valid, x (1 + coherence)."""
    top = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("conf"), "read_id"))).where(F.col("_rn") <= most)
    score = F.length("text") / 8 * F.when(p.valid_format("text"), 1.5).otherwise(1.0) * (1 + p.pattern_coherence("text"))
    return top.groupBy(key).agg(F.max_by(F.struct("text", F.round(score, 6).alias("score")), F.struct(F.round(score, 9), -F.col("_rn"))).alias("b")).select(key, "b.*")


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def best_per_vehicle(df: DataFrame, key: str, sharpness: str | None = None) -> DataFrame:
    scored = df.withColumn("score", p.detection_score("text", sharpness))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "read_id")
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def segment_dedup(df: DataFrame, keys: list[str], longest: int = 7) -> DataFrame:
    """Greedy, sharpest first: drop texts of equal length that differ from a kept one in at
    most one (up to six characters) or two places."""
    fit = df.where(p.valid_length("text", longest) & (F.col("text") != ""))
    grouped = fit.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("sharpness")).alias("s"), "read_id", "text"))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    near = lambda k, x: F.coalesce(p.hamming(k["text"], x["text"]) <= F.when(F.length(x["text"]) <= 6, 1).otherwise(2), F.lit(False))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.array_append(acc, x)))
    return grouped.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.read_id", "k.text")


def canonicalise(df: DataFrame, variants: DataFrame, col: str = "text") -> DataFrame:
    """``variants``: ``canonical, variant``, each variant once."""
    v = variants.select(F.col("variant").alias("_v"), "canonical")
    return df.join(v, F.col(col) == F.col("_v"), "left").withColumn("canonical", F.coalesce("canonical", F.col(col))).drop("_v")


def fuzzy_candidates(texts: DataFrame, variants: DataFrame, least: float) -> DataFrame:
    """Pairs of distinct ``_t`` and rows of ``variants`` (``_v``) that may be alike enough."""
    return by_shared_places(texts, variants, "_t", "_v", least, 0.1)


def canonicalise_fuzzy(df: DataFrame, variants: DataFrame, night: bool = False, col: str = "text") -> DataFrame:
    """The first canonical plate with a variant alike enough: shared places over the shorter
    length, 0.1 more for equal length. ``variants``: ``rank, canonical, variant``; the
    smallest rank that accepts wins.

    Distinct texts meet variants under keys with as many places masked as may differ, so no
    pair is lost and few others meet. Without a shared place nothing is alike.
    """
    least = 0.65 if night else 0.70
    texts = df.select(F.col(col).alias("_t")).where("_t <> ''").distinct()
    other = variants.select("rank", "canonical", F.col("variant").alias("_v")).where("_v <> ''")
    like = p.positional_matches("_t", "_v") / F.least(F.length("_t"), F.length("_v")) + F.when(F.length("_t") == F.length("_v"), 0.1).otherwise(0.0)
    best = fuzzy_candidates(texts, other, least).where(like >= least).groupBy("_t").agg(F.min_by("canonical", "rank").alias("canonical"))
    return df.join(best, F.col(col) == F.col("_t"), "left").withColumn("canonical", F.coalesce("canonical", F.col(col))).drop("_t")


def version_candidates(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of texts ``_t`` and plates ``_k`` of equal length that may differ in two places."""
    return equal_length(texts, known, "_t", "_k", 2)


def best_plate_version(df: DataFrame, known: DataFrame, col: str = "text") -> DataFrame:
    """The known plate of equal length that differs in at most two places, the smallest of
    several; else the text. Keys have two places masked, so the pairs that meet are those."""
    texts = df.select(F.col(col).alias("_t")).distinct()
    other = known.select(F.col("plate").alias("_k")).distinct()
    pairs = version_candidates(texts, other).where(p.hamming("_t", "_k") <= 2)
    best = pairs.groupBy("_t").agg(F.min_by("_k", F.struct(p.hamming("_t", "_k") > 0, "_k")).alias("version"))
    return df.join(best, F.col(col) == F.col("_t"), "left").withColumn("version", F.coalesce("version", F.col(col))).drop("_t")


def plate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``id, t`` and the normal form ``x`` of every read that has a plate."""
    return df.withColumn("x", p.normal_plate("text")).where("x <> ''").select(*keys, F.col("read_id").alias("id"), "t", "x")


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with the longest run of digits ``m`` of their plate ``x`` (null if shorter than
    three) and its form ``f`` without look-alikes."""
    run = p.longest_digit_run("x")
    return rows.withColumns({"m": F.when(F.length(run) >= 3, run), "f": p.fold_confusable("x")})


def plate_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct plates ``x`` of each group with their parts ``m`` and ``f``."""
    return with_parts(rows.select(*keys, "x").distinct())


def run_pairs(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs ``m <= n`` of distinct runs of one group that share their last three digits, and
    the similarity ``s`` that they give their plates."""
    runs = texts.where("m is not null").select(*keys, "m").distinct().withColumn("_d", F.right("m", F.lit(3)))
    both = runs.join(runs.withColumnRenamed("m", "n"), [*keys, "_d"]).where("m <= n").drop("_d")
    return both.withColumn("s", F.when(F.col("m") == F.col("n"), 0.85).otherwise(_digits("m", "n")))


def _digits(m: str, n: str) -> Column:
    """Similarity of different runs of digits with the same last three."""
    return 0.6 + p.common_suffix(m, n) / F.greatest(F.length(m), F.length(n)) * 0.3


def no_shared_digits(m: str, n: str) -> Column:
    return ~F.coalesce(F.right(F.col(m), F.lit(3)) == F.right(F.col(n), F.lit(3)), F.lit(False))


def form_similarity(m: str, n: str) -> Column:
    """Similarity of different plates of one form with these runs of digits."""
    digits = F.when(no_shared_digits(m, n), 0.0).when(F.col(m) == F.col(n), 0.85).otherwise(_digits(m, n))
    return F.when(digits < 0.8, 0.85).otherwise(digits)


def reaches(s: Column, least: float) -> Column:
    """Whether reads of plates with this similarity could reach ``least``."""
    return F.round(F.greatest(s, s * 6 / 7 + 1 / 7), 9) >= least


def rounded(x: Column, places: int) -> Column:
    """``round`` of a number from 0 to 1, without decimals where the last place is clear."""
    scale = float(10**places)
    far = F.abs(x * scale - F.floor(x * scale) - 0.5) > 1e-4
    return F.when(far, F.rint(x * scale) / scale).otherwise(F.round(x, places))


def border(least: float) -> float:
    """Where numbers begin that are ``least`` or more once rounded to nine places: what is so
    but for the rounding of sums counts as such."""
    return float(Decimal(str(least)).quantize(Decimal("1e-9"), ROUND_CEILING) - Decimal("5e-10"))


#: Reads of one node that lie in one row: two such rows are met in one task.
BLOCK = 4096


def paired(pairs: DataFrame, rows: DataFrame, node: list[str], other: list[str], *cols: str) -> DataFrame:
    """``pairs`` of nodes with ``a`` and ``b``, a row of each node (``cols`` of ``rows``, which
    have the columns ``node`` and ``id``). A node with itself (``same``) gives each pair once.

    Rows of a node travel as lists of up to :data:`BLOCK`, once for each pair of nodes, and
    meet within tasks: no pair of rows is ever sent, and large nodes are dealt out.
    """
    large = materialize(rows.groupBy(*node).agg(F.ceil(F.count("*") / BLOCK).alias("_k")).where("_k > 1"), "large-nodes")
    dealt = rows.join(large, node, "left").withColumn("_i", F.coalesce(F.pmod(F.xxhash64("id"), "_k"), F.lit(0)))
    lists = materialize(dealt.groupBy(*node, "_i").agg(F.collect_list(F.struct(*cols)).alias("_rows")), "blocks")
    ends = large.withColumnsRenamed(dict(zip(node, other)))
    wanted = pairs.join(ends, other, "left").withColumn("_j", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1))).drop("_k")
    one = wanted.join(lists.withColumnRenamed("_rows", "_a"), node).where("not same or _i <= _j")
    two = lists.withColumnsRenamed({**dict(zip(node, other)), "_i": "_j", "_rows": "_b"})
    # All work is in what follows, so it is dealt out however few bytes that is.
    both = one.repartition(partitions(rows.sparkSession), *other, "_j").join(two, [*other, "_j"])
    both = both.withColumn("a", F.explode("_a")).withColumn("b", F.explode("_b"))
    return both.where("not same or _i < _j or a.id < b.id").drop("_a", "_b", "_i", "_j")


def alike_runs(texts: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs ``m, n`` of runs of digits (``same``: of one) whose plates may reach ``least``."""
    runs = run_pairs(texts, keys).withColumn("same", F.expr("m = n"))
    return materialize(runs.where(F.col("same") | reaches(F.col("s"), least)), "alike-runs")


def alike_forms(texts: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs ``m, n`` of the runs of digits (empty without one) that plates of one form ``f``
    have, where these alone (:func:`alike_runs`) do not pair them, and their similarity ``s``."""
    parts = texts.select(*keys, "f", "m").distinct()
    met = parts.join(parts.withColumnRenamed("m", "n"), [*keys, "f"]).where("coalesce(m, '') <= coalesce(n, '')")
    left = met.where(no_shared_digits("m", "n") | (F.expr("m <> n") & ~reaches(_digits("m", "n"), least)))
    left = left.withColumn("s", form_similarity("m", "n")).fillna("", ["m", "n"])
    return materialize(left.withColumn("same", F.expr("m = n")), "alike-forms")


def text_pairs(read: DataFrame, runs: DataFrame, forms: DataFrame, keys: list[str], *cols: str) -> tuple[DataFrame, DataFrame]:
    """All pairs of reads whose texts are alike by their digits, and those by their form alone:
    ``id_a, t_a, id_b, t_b``, the same of ``cols``, and the similarity ``s`` of their texts;
    ``read`` as of :func:`with_parts`, ``runs`` and ``forms`` of :func:`alike_runs` and
    :func:`alike_forms`.

    Lossless blocks: plates are alike only if equal after folding look-alikes, or if they share
    the last three digits of their longest run of digits. Texts are compared once for each
    pair of distinct runs and forms.
    """
    by_digits = paired(runs, read.where("m is not null"), [*keys, "m"], [*keys, "n"], "id", "t", "x", "f", *cols)
    by_form = paired(forms, read.fillna("", ["m"]), [*keys, "f", "m"], [*keys, "f", "n"], "id", "t", "x", *cols)
    equal = F.when(F.col("same") & F.expr("a.x = b.x"), 1.0)
    sides = [F.col(f"{k}.{c}").alias(f"{c}_{k}") for k in "ab" for c in ("id", "t", *cols)]
    put = lambda pairs, s: pairs.select(*keys, *sides, s.otherwise(F.col("s")).alias("s"))
    return put(by_digits, equal.when((F.col("s") < 0.8) & F.expr("a.f = b.f"), 0.85)), put(by_form, equal)


def ends(pairs: DataFrame, keys: list[str], *more: str | Column) -> DataFrame:
    """``a < b``: the smaller and the larger read of each pair, its similarity and ``more``."""
    return pairs.select(*keys, F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity", *more)


def _fused(s: str, dt: Column) -> Column:
    return p.fused_similarity(F.col(s), F.lit(0.0), p.time_similarity(dt))


def dup_pairs(df: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Pairs ``a < b`` of one group with their fused similarity (no images), from ``least`` on.

    All pairs are asked for, so rows grow with the square of a group: for groups of duplicates
    see :func:`dup_classes`.
    """
    read = materialize(with_parts(plate_rows(df, keys)), "plate-rows")
    both = reduce(DataFrame.unionByName, text_pairs(read, alike_runs(read, keys, least), alike_forms(read, keys, least), keys))
    return ends(both.withColumn("similarity", _fused("s", F.col("t_a") - F.col("t_b"))).where(F.col("similarity") >= border(least)), keys)


def dup_classes(df: DataFrame, keys: list[str], least: float = 0.80) -> DataFrame:
    """``node, root`` of the groups that pairs of reads from ``least`` on make, without making
    the pairs (no images).

    Reads of one plate are always linked (6/7 at least), so plates are nodes. Reads that are
    five seconds apart or more, or have no time, have the texts' similarity itself. So plates
    that are alike by a common run of digits, or by form, are one node where their reads span
    ten seconds: each is five seconds from the first or the last. What is left are pairs of
    nodes with different runs, and plates whose reads lie close in time. Two nodes are linked
    by a pair of reads that is far, and only where none is are their near reads looked at.
    """
    if least > 6 / 7:
        raise ValueError("reads of one plate are linked for sure up to 6/7 only")
    rows = materialize(plate_rows(df, keys), "plate-rows")
    seen = rows.groupBy(*keys, "x").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_if(F.col("t").isNull()).alias("timeless"))
    plates = materialize(seen.join(plate_texts(rows, keys), [*keys, "x"]), "plates")
    spans = (F.min("first").alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("timeless").alias("timeless"), F.count("*").alias("plates"))
    whole = F.coalesce(F.col("hi") - F.col("lo") >= 10, F.lit(False)) | (F.col("timeless") > 0)
    # Nodes, named ``u`` by a read: a run of digits that holds together, else a plate.
    runs = plates.where("m is not null").groupBy(*keys, "m").agg(*spans).where(whole & F.lit(least <= 0.85)).select(*keys, "m", "held")
    placed = materialize(plates.join(runs, [*keys, "m"], "left").withColumn("u", F.coalesce("held", "first")).drop("held"), "placed")
    edges = placed.where("u <> first").select(F.col("first").alias("a"), F.col("u").alias("b"))
    forms = placed.groupBy(*keys, "f").agg(*spans).where("plates > 1").select(*keys, "f", "held", (whole & F.lit(least <= 0.8)).alias("whole"))
    formed = placed.join(forms, [*keys, "f"])
    edges = edges.unionByName(formed.where("whole").select(F.col("u").alias("a"), F.col("held").alias("b")))
    # Pairs of nodes with their digits' similarity, and of plates (``kind`` 0) of a form that does
    # not hold together.
    about = ("id", "lo", "hi", "timeless")
    side = lambda d, k, *more: d.select(*keys, *more, *(F.col(c).alias(f"{c}_{k}") for c in about))
    nodes = placed.groupBy(*keys, "m", F.col("u").alias("id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("timeless").alias("timeless"))
    by_digits = run_pairs(plates, keys).join(side(nodes, "a", "m"), [*keys, "m"]).join(side(nodes, "b", F.col("m").alias("n")), [*keys, "n"]).where("m <> n or id_a < id_b")
    loose = formed.where("not whole").withColumn("id", F.col("first"))
    met = side(loose, "a", "f", "m", "u").join(side(loose, "b", "f", F.col("m").alias("n"), F.col("u").alias("v")), [*keys, "f"]).where("id_a < id_b and u <> v")
    by_form = met.withColumn("s", form_similarity("m", "n"))
    columns = ["s", *(f"{c}_{k}" for k in "ab" for c in about)]
    pairs = by_digits.select(F.lit(1).alias("kind"), *columns).unionByName(by_form.select(F.lit(0).alias("kind"), *columns)).where((F.col("s") >= least) | (F.col("s") * 6 / 7 + 1 / 7 >= least))
    far = F.coalesce(F.greatest(F.col("hi_a") - F.col("lo_b"), F.col("hi_b") - F.col("lo_a")) >= APART, F.lit(False)) | (F.col("timeless_a") + F.col("timeless_b") > 0)
    pairs = materialize(pairs.select("kind", "s", "id_a", "id_b", ((F.col("s") >= least) & far).alias("sure")), "node-pairs")
    open_ = pairs.where("not sure")
    times = rows.where("t is not null").join(placed.select(*keys, "x", "first", "u"), [*keys, "x"])
    times = times.select("t", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("first").alias("id")), F.struct(F.lit(1).alias("kind"), F.col("u").alias("id")))).alias("k")).select("t", "k.*")
    times = times.join(open_.select("kind", F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), ["kind", "id"], "left_semi").distinct()
    slot = F.floor(F.col("t") / APART)
    a = times.select("kind", F.col("id").alias("id_a"), F.col("t").alias("ta"), slot.alias("slot"))
    b = times.select("kind", F.col("id").alias("id_b"), F.col("t").alias("tb"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    near = open_.join(a, ["kind", "id_a"]).join(b, ["kind", "id_b", "slot"]).where(_fused("s", F.col("ta") - F.col("tb")) >= least)
    edges = edges.unionByName(pairs.where("sure").unionByName(near.select(*pairs.columns)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).where("a <> b").distinct()
    roots = components(edges)
    named = placed.join(roots, placed["first"] == roots["node"], "left").where("n > 1 or root is not null").select(*keys, "x", F.coalesce("root", "first").alias("root"))
    return rows.join(named, [*keys, "x"]).select(F.col("id").alias("node"), "root")


def dup_groups(pairs: DataFrame, least: float = 0.80, least_with_images: float = 0.75) -> DataFrame:
    """``node, root`` of the duplicate groups of given pairs: those from ``least`` on, and from
    ``least_with_images`` where a column ``both_images`` says that both have one."""
    linked = F.col("similarity") >= least
    if "both_images" in pairs.columns:
        linked = linked | (F.col("both_images") & (F.col("similarity") >= least_with_images))
    return components(pairs.where(linked).select("a", "b"))


def best_per_group(df: DataFrame, groups: DataFrame, id_col: str = "read_id", vehicle: str | None = None) -> DataFrame:
    """Every row without a group, and of each group the best by quality (ties: smaller id);
    ``vehicle`` names the quality of the vehicle's picture, null without one."""
    rows = df.join(groups.select(F.col("node").alias(id_col), F.col("root").alias("group_id")), id_col, "left").withColumn("group_id", F.coalesce("group_id", F.col(id_col)))
    quality = p.quality_score("text", F.col("conf"), F.col(vehicle) if vehicle else F.lit(None).cast("double"))
    best = rows.groupBy("group_id").agg(F.max_by(id_col, F.struct(F.round(quality, 9), -F.col(id_col))).alias(id_col), F.count("*").alias("members"))
    return df.join(best, id_col)


def dedup_plates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates resolved: links, groups, the best of each group."""
    return best_per_group(df, dup_classes(df, keys))
