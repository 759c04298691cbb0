"""Exact k nearest neighbours over sparse non-negative vectors in long form (id, feature, weight).

Both distances come from one quantity, ``gap = (|a|^2 + |b|^2) / 2 - a.b``:

* cosine, on unit vectors: distance = gap
* Euclidean: distance = sqrt(2 * gap)

so a larger dot product is always nearer, and everything below only deals with dot products.

Where many ids share the features, blocks of ids are scored against blocks of ids, and only the k best of each
leave a task (``blocked``). That is done if the entries it copies are fewer than the pairs that joins make.

Otherwise features are taken apart by how many ids have them:

* **rare** (at most ``hot_degree`` ids): each entry meets at most ``hot_degree`` partners, so the work grows
  linearly with the data, and no key is skewed. Where all features are rare, queries get the lists of ids that
  have their features and are complete in one task (``postings``); beside hot features, it is a join.
* **hot** (more): never joined on. ``hot_features`` scores blocks of ids against blocks of ids and
  keeps only the k best of each block, so that the pairs of a hot feature are never written out.
* **shared by nobody** (Euclidean only): without a common feature the nearest are simply those with
  the smallest norm, k rows for the whole data set.

The three sets of candidates together hold the k nearest for certain; see ``hot_features`` for why.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import grid
from basketry.operators import blocked
from basketry.operators.positions import with_position
from basketry.operators.postings import posting_candidates
from basketry.storage import save

HOT_DEGREE = 512
_PAIRS_PER_TASK = 250_000
# Removes summation noise below the square root, where it would otherwise grow.
_GAP_DIGITS = 12


@dataclass(frozen=True)
class Problem:
    """Vectors ready for scoring. ``ids`` maps text ids to numbers in the same order."""

    metric: str
    keep: int
    ids: DataFrame  # id, idx, q_sq, b_sq
    queries: DataFrame  # idx, feature, w, sq
    base: DataFrame  # same columns
    symmetric: bool
    features: dict[str, DataFrame]  # the feature of each entry, by side, as the entries were given


def distance(gap: Column, metric: str) -> Column:
    """Distance on the 8-decimal grid that ranking uses."""
    clean = grid(F.greatest(gap, F.lit(0.0)), _GAP_DIGITS)
    return grid(clean if metric == "cosine" else F.sqrt(2.0 * clean))


def cosine_neighbors(base, k=10, queries=None, include_self=True, hot_degree=HOT_DEGREE,
                     id_col="cont_id", feature_col="prod_name", by=None) -> DataFrame:
    """The k nearest by cosine among those sharing a feature: id, neighbor_id, dist, neighbor_rank.

    ``by``: ``"blocks"`` or ``"features"`` instead of whichever moves less.
    """
    return _neighbors(
        "cosine", base, k, queries, include_self, hot_degree, id_col, feature_col, by
    )


def euclidean_neighbors(base, k=10, queries=None, include_self=True, hot_degree=HOT_DEGREE,
                        id_col="cont_id", feature_col="prod_name", by=None) -> DataFrame:
    """The k nearest by Euclidean distance among all ids, with or without a shared feature."""
    return _neighbors(
        "euclidean", base, k, queries, include_self, hot_degree, id_col, feature_col, by
    )


def _neighbors(metric, base, k, queries, include_self, hot_degree, id_col, feature_col, by):
    from basketry.operators.hot_features import hot_candidates

    problem = _prepare(
        metric, base, queries, k if include_self else k + 1, id_col, feature_col
    )
    degrees = _degrees(problem)
    shared = F.col("degree").isNotNull()
    facts = degrees.agg(
        F.max("degree").alias("top"),
        F.sum(F.when(F.col("degree") <= hot_degree, F.col("work"))).alias("work"),
        F.sum(F.col("work").cast("double")).alias("pairs"),
        *[F.sum(n).alias(f"all_{n}") for n in ("nb", "nq")],
        *[F.sum(F.when(shared, F.col(n))).alias(f"met_{n}") for n in ("nb", "nq")],
        F.max(F.when(~shared, F.col("nb"))).alias("lone"),
    ).first()
    tasks = 1 + int(facts.work or 0) // _PAIRS_PER_TASK
    grid_ = blocked.grid_of(problem) if by != "features" else None

    if by == "blocks" or (grid_ and blocked.worth_it(grid_, facts.pairs or 0)):
        candidates = blocked.block_candidates(problem, grid_)
    elif (facts.top or 0) <= hot_degree:
        # Features that one side alone has make no pair. They are looked for only where that leaves out most entries of
        # the side, or where too many ids of the base have one to be a list.
        most = {"base": (facts.lone or 0) > hot_degree or (facts.all_nb or 0) > 2 * (facts.met_nb or 0),
                "queries": (facts.all_nq or 0) > 2 * (facts.met_nq or 0)}
        known = {side: degrees.filter(shared).select("feature") for side, trim in most.items() if trim}
        candidates = posting_candidates(problem, known, facts.pairs or 0)
    else:
        hot = save(
            degrees.filter(F.col("degree") > hot_degree)
            .select("feature")
            .withColumn("fid", F.monotonically_increasing_id()),
            "hot",
        )
        candidates = hot_candidates(problem, hot, tasks)
    if metric == "euclidean":
        candidates = candidates.unionByName(_smallest_norms(problem))
        # A pair can be listed both with its dot product and without: the smaller gap is the true one.
        candidates = candidates.groupBy("q", "n").agg(F.min("gap").alias("gap"))
    ranked = top_candidates(candidates, metric, k, include_self)
    return _with_text_ids(ranked, problem.ids, id_col)


def refitted(lists: DataFrame, changed: DataFrame, base: DataFrame, k=10, id_col="cont_id",
             feature_col="prod_name") -> DataFrame:
    """``lists`` of the k nearest by cosine, brought up to date with ``base``, in which the ids ``changed`` differ.

    ``changed`` holds every id whose vector is new, gone or another one than when the lists were made. A list
    is worked out anew only if it is that of a changed id or has one in it. To all others a changed id can only
    be added: the k nearest of the changed ids are merged with the list. The result is that of all lists anew.
    """
    changed = save(changed.select(id_col).distinct(), "changed")
    stale = renewed(lists, changed, id_col)

    def part(ids, how):
        # Each is read for the norms, the vectors and the degrees.
        return save(base.join(ids, id_col, how), "part")

    fresh = cosine_neighbors(
        base, k, part(stale, "left_semi"), id_col=id_col, feature_col=feature_col
    )
    added = cosine_neighbors(
        part(changed, "left_semi"), k, part(stale, "left_anti"), id_col=id_col, feature_col=feature_col
    )
    nearest = Window.partitionBy(id_col).orderBy("dist", "neighbor_id")
    columns = [id_col, "neighbor_id", "dist"]
    merged = (
        lists.join(stale, id_col, "left_anti")
        .select(*columns)
        .unionByName(added.select(*columns))
        .withColumn("neighbor_rank", F.row_number().over(nearest))
        .filter(F.col("neighbor_rank") <= k)
    )
    return merged.unionByName(fresh)


def renewed(lists: DataFrame, changed: DataFrame, id_col="cont_id") -> DataFrame:
    """The ids whose lists have to be worked out anew: those that changed or have one that did in their list."""
    met = lists.join(changed.select(F.col(id_col).alias("neighbor_id")), "neighbor_id", "left_semi")
    return save(met.select(id_col).union(changed.select(id_col)).distinct(), "renewed")


def _prepare(metric, base, queries, keep, id_col, feature_col) -> Problem:
    def entries(df):
        return df.select(
            F.col(id_col).alias("id"),
            F.col(feature_col).alias("feature"),
            F.col("weight").cast("double").alias("w"),
        )

    symmetric = queries is None
    sides = {"b": entries(base)} if symmetric else {"q": entries(queries), "b": entries(base)}
    tagged = None
    for side, rows in sides.items():
        rows = rows.withColumn("side", F.lit(side))
        tagged = rows if tagged is None else tagged.unionByName(rows)

    def squared(side):
        mine = F.when(F.col("side") == side, F.col("w") * F.col("w"))
        return grid(F.sum(mine), _GAP_DIGITS) if metric == "euclidean" else F.sum(mine)

    b_sq = squared("b")
    q_sq = b_sq if symmetric else squared("q")
    norms = tagged.groupBy("id").agg(q_sq.alias("q_sq"), b_sq.alias("b_sq"))
    # A sorted number per id: compact keys for the pair tables, and the same order in every tie.
    ids = save(with_position(norms, ["id"], "idx"), "ids")

    def vectors(side):
        own = ids.select("id", "idx", F.col(f"{side}_sq").alias("sq"))
        rows = sides[side].filter(F.col("w") > 0).join(own, "id")
        if metric == "cosine":
            rows = rows.withColumn("w", F.col("w") / F.sqrt("sq")).withColumn("sq", F.lit(1.0))
        return save(rows.select("idx", "feature", "w", "sq"), "vectors")

    b_vectors = vectors("b")
    q_vectors = b_vectors if symmetric else vectors("q")
    given = {side: rows.filter(F.col("id").isNotNull() & (F.col("w") > 0)) for side, rows in sides.items()}
    given = {side: rows.select("feature") for side, rows in given.items()}
    return Problem(metric, keep, ids, q_vectors, b_vectors, symmetric, given)


def _degrees(problem: Problem) -> DataFrame:
    """feature, nb and nq ids on either side; where both have it, the larger and the pairs that joining on it would make.

    Counted on the entries as they were given: weights are written product by product, so that Spark adds up most
    before the shuffle; the vectors are dealt by id.
    """
    base = problem.features["b"].groupBy("feature").agg(F.count("*").alias("nb"))
    if problem.symmetric:
        return base.select(
            "feature", "nb", F.col("nb").alias("nq"), F.col("nb").alias("degree"),
            (F.col("nb") * F.col("nb")).alias("work"),
        )
    asked = problem.features["q"].groupBy("feature").agg(F.count("*").alias("nq"))
    both = F.col("nb").isNotNull() & F.col("nq").isNotNull()
    return base.join(asked, "feature", "full").select(
        "feature",
        "nb",
        "nq",
        F.when(both, F.greatest("nb", "nq")).alias("degree"),
        (F.col("nb") * F.col("nq")).alias("work"),
    )


def rare_dots(problem: Problem, queries: DataFrame, base: DataFrame, tasks: int, *extra) -> DataFrame:
    """Dot products over rare features: q, n, dot, and per vector the columns named by ``extra``.

    ``tasks`` spreads the join by its output, which is known, and not by its much smaller input.
    Euclidean distances also need the squared norms; unit vectors do not carry them.
    """
    carried = [*extra] if problem.metric == "cosine" else ["sq", *extra]

    def side(rows, idx):
        named = rows.select(
            "feature",
            F.col("idx").alias(idx),
            F.col("w").alias(f"{idx}_w"),
            *[F.col(c).alias(f"{idx}_{c}") for c in carried],
        )
        return named.repartition(tasks, "feature") if tasks > 1 else named

    pairs = side(queries, "q").join(side(base, "n"), "feature")
    if problem.symmetric:
        pairs = pairs.filter(F.col("q") <= F.col("n"))
    dots = pairs.groupBy("q", "n").agg(
        F.sum(F.col("q_w") * F.col("n_w")).alias("dot"),
        *[F.max(f"{s}_{c}").alias(f"{s}_{c}") for c in carried for s in ("q", "n")],
    )
    return _both_ends(dots, carried) if problem.symmetric else dots


def _both_ends(dots: DataFrame, carried) -> DataFrame:
    """Each unordered pair was computed once; list it from both ends."""

    def row(first, second):
        return F.struct(
            F.col(first).alias("q"),
            F.col(second).alias("n"),
            F.col("dot"),
            *[
                F.col(f"{own}_{c}").alias(f"{end}_{c}")
                for c in carried
                for own, end in ((first, "q"), (second, "n"))
            ],
        )

    same = F.col("q") == F.col("n")
    rows = F.when(same, F.array(row("q", "n"))).otherwise(F.array(row("q", "n"), row("n", "q")))
    return dots.select(F.inline(rows))


def gap_of(metric: str):
    """Gap of a pair table row from its dot product and, where needed, its squared norms."""
    if metric == "cosine":
        return 1.0 - F.col("dot")
    return (F.col("q_sq") + F.col("n_sq")) / 2 - F.col("dot")


def _smallest(problem: Problem) -> DataFrame:
    """The ``keep`` base ids of smallest norm."""
    known = problem.ids.filter(F.col("b_sq").isNotNull())
    return known.orderBy("b_sq", "idx").limit(problem.keep)


def _smallest_norms(problem: Problem) -> DataFrame:
    """Every query with the ``keep`` base ids of smallest norm, taken as sharing nothing with it."""
    smallest = (
        _smallest(problem)
        .agg(F.collect_list(F.struct(F.col("idx").alias("n"), "b_sq")))
        .scalar()
    )
    asked = problem.ids.filter(F.col("q_sq").isNotNull())
    listed = asked.select(F.col("idx").alias("q"), "q_sq", F.inline(smallest))
    return listed.select("q", "n", ((F.col("q_sq") + F.col("b_sq")) / 2).alias("gap"))


def top_candidates(candidates: DataFrame, metric: str, k: int, include_self: bool = True) -> DataFrame:
    """The k nearest per query by (distance, id). The limit is applied before the shuffle too."""
    if not include_self:
        candidates = candidates.filter(F.col("q") != F.col("n"))
    nearest = Window.partitionBy("q").orderBy("dist", "n")
    return (
        candidates.withColumn("dist", distance(F.col("gap"), metric))
        .withColumn("neighbor_rank", F.row_number().over(nearest))
        .filter(F.col("neighbor_rank") <= k)
        .select("q", "n", "gap", "dist", "neighbor_rank")
    )


def _with_text_ids(ranked, ids, id_col):
    asked = ids.select(F.col("idx").alias("q"), F.col("id").alias(id_col))
    found = ids.select(F.col("idx").alias("n"), F.col("id").alias("neighbor_id"))
    return (
        ranked.join(asked, "q")
        .join(found, "n")
        .select(id_col, "neighbor_id", "dist", "neighbor_rank")
    )
