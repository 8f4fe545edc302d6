"""Similarity recommendations: scaling, segments, components, neighbours and product scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import decode_risk
from ..functions.numbers import half_up, num, points
from ..operators.neighbours import nearest
from ..operators.ordered import exact_quantiles
from ..operators.pairing import first_with, pair_with
from .features import DW_FEATURES
from .rules import _phrases, best_per_customer, falling

# Fixed values of the model.
NEIGHBOURS_KEPT, NEIGHBOURS_ASKED, NEIGHBOURS_WEIGHTED = 50, 15, 10
SEGMENTS, RESTARTS, COMPONENTS, SEED = 10, 10, 15, 42
NEUTRAL_SIMILARITY = 50.0
PARALLEL_FITS = 4


def clean_features(features: DataFrame) -> DataFrame:
    """NaN, null and infinities of every feature become 0 (bulk form of ``finite_or_zero``)."""
    clean = "CASE WHEN {0} IS NULL OR isnan({0}) OR abs({0}) = double('Infinity') THEN 0.0D ELSE {0} END AS {0}"
    return features.selectExpr("customer_id", *[clean.format(c) for c in DW_FEATURES])


@dataclass(frozen=True)
class RobustScale:
    """Median and interquartile range per feature; a range of 0 counts as 1."""

    centre: dict[str, float]
    spread: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> RobustScale:
        found = {c: q for c, q in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items() if q}
        centre = {c: q[0.5] for c, q in found.items()}
        spread = {c: (q[0.75] - q[0.25]) or 1.0 for c, q in found.items()}
        return RobustScale(centre, spread)

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = {c: f"({c} - {self.centre[c]!r}D) / {self.spread[c]!r}D AS {c}" for c in self.centre}
        return df.selectExpr(*[scaled.get(c, c) for c in df.columns])


def scaled_features(features: DataFrame) -> DataFrame:
    cleaned = clean_features(features)
    return RobustScale.fit(cleaned, DW_FEATURES).apply(cleaned)


def as_array(scaled: DataFrame) -> DataFrame:
    return scaled.select("customer_id", F.array(*DW_FEATURES).alias("features"))


def customer_neighbours(scaled: DataFrame, k: int = NEIGHBOURS_ASKED, probes: int | None = None) -> DataFrame:
    """The k most similar customers, the customer itself included; similarity = max(0, 1 - distance)."""
    found = nearest(as_array(scaled), k, id_column="customer_id", vector="features", probes=probes)
    similarity = half_up(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance")), 3)
    return found.select(F.col("query_id").alias("customer_id"), F.col("neighbour_id").alias("similar_customer_id"),
                        similarity.alias("similarity_score"), "rank")


def _vectors(scaled: DataFrame) -> DataFrame:
    return scaled.select("customer_id", array_to_vector(F.array(*DW_FEATURES)).alias("features"))


def segments(vectors: DataFrame, k: int = SEGMENTS, restarts: int = RESTARTS, seed: int = SEED) -> tuple[KMeansModel, DataFrame]:
    """Best of several k-means runs by training cost, and each row with its segment."""
    cached = vectors.persist()
    k = max(2, min(k, cached.count()))

    def fit(run: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + run, featuresCol="features", predictionCol="segment").fit(cached)

    # Restarts are independent jobs: a few at a time keep the cluster busy between iterations.
    with ThreadPool(min(PARALLEL_FITS, restarts)) as pool:
        models = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(restarts))
    best = min(models, key=lambda m: m.summary.trainingCost)
    cached.unpersist()
    return best, best.transform(vectors)


def customer_segments(scaled: DataFrame, k: int = SEGMENTS, restarts: int = RESTARTS) -> DataFrame:
    return segments(_vectors(scaled), k, restarts)[1].select("customer_id", "segment")


def principal_components(scaled: DataFrame, k: int = COMPONENTS):
    """Fitted components on centred features (the covariance is features x features)."""
    vectors = _vectors(scaled)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(vectors).transform(vectors)
    model = PCA(k=min(k, len(DW_FEATURES)), inputCol="centred", outputCol="components").fit(centred)
    return model, model.transform(centred)


def component_variance(scaled: DataFrame, k: int = COMPONENTS) -> DataFrame:
    model, _ = principal_components(scaled, k)
    shares = [float(v) for v in model.explainedVariance]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(v).alias("explained_variance")) for i, v in enumerate(shares)])
    return scaled.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def total_variance(scaled: DataFrame) -> DataFrame:
    """Number of all components and the sum of their variances, which is that of the features."""
    _, rows = principal_components(scaled, len(DW_FEATURES))
    parts = rows.select(vector_to_array("components").alias("c"))
    spread = [F.var_pop(F.col("c")[i]) for i in range(len(DW_FEATURES))]
    return parts.agg(sum(spread[1:], spread[0]).alias("total_variance")).select(F.lit(len(DW_FEATURES)).alias("components"), "total_variance")


def segment_check(scaled: DataFrame, k: int = SEGMENTS, restarts: int = RESTARTS) -> DataFrame:
    """Customers, segments in use, and customers that some other segment's centre is nearer to than their own."""
    model, rows = segments(_vectors(scaled), k, restarts)
    own = rows.select("segment", vector_to_array("features").alias("f"))
    gaps = F.array(*[F.aggregate(F.zip_with("f", F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
                     for centre in model.clusterCenters()])
    worse = F.get(gaps, F.col("segment")) > F.array_min(gaps) * (1 + 1e-9) + 1e-9
    return own.agg(F.count("*").alias("customers"), F.countDistinct("segment").alias("segments"), F.count(F.when(worse, 1)).alias("misplaced"))


def approximate_recall(scaled: DataFrame, probes: int, k: int = NEIGHBOURS_ASKED) -> DataFrame:
    """Customers, share of their exact neighbours that the approximate search finds, and pairs whose similarity differs."""
    exact = customer_neighbours(scaled, k).select("customer_id", "similar_customer_id", F.col("similarity_score").alias("exact"))
    near = customer_neighbours(scaled, k, probes).select("customer_id", "similar_customer_id", "similarity_score")
    both = exact.join(near, ["customer_id", "similar_customer_id"], "left")
    return both.agg(F.countDistinct("customer_id").alias("customers"), (F.count("similarity_score") / F.count("*")).alias("recall"),
                    F.count(F.when(F.abs(F.col("exact") - F.col("similarity_score")) > 1e-9, 1)).alias("differing"))


def model_stats(scaled: DataFrame, products: DataFrame) -> DataFrame:
    customers = scaled.agg(F.count("*").alias("total_customers"))
    available = products.filter("is_active").agg(F.count("*")).scalar()
    return customers.select(
        "total_customers", F.lit(len(DW_FEATURES)).alias("feature_dimensions"),
        F.least(F.lit(NEIGHBOURS_KEPT), F.col("total_customers")).cast("int").alias("n_neighbors"),
        F.least(F.lit(SEGMENTS), F.col("total_customers")).cast("int").alias("n_clusters"), available.alias("available_products"))


def similarity_score(neighbours: DataFrame, top: int = NEIGHBOURS_WEIGHTED) -> DataFrame:
    """Per customer 0.8 * sum(s^2) / sum(s) * 100 over the nearest, the same for every product.

    Similarities are whole thousandths, so both sums are exact.
    """
    s = F.floor(F.col("similarity_score") * 1000 + 0.5)
    sums = neighbours.filter(F.col("rank") <= top).groupBy("customer_id").agg(F.sum(s * s).alias("squares"), F.sum(s).alias("weights"))
    score = num("squares") * 80 / F.when(F.col("weights") > 0, num("weights") * 1000)
    return sums.select("customer_id", half_up(F.coalesce(score, F.lit(NEUTRAL_SIMILARITY)), 6).alias("similarity_score"))


def owned_similarity(neighbours: DataFrame, owned: DataFrame, top: int = NEIGHBOURS_WEIGHTED) -> DataFrame:
    """Per customer and product: the share of neighbour weight that holds the product, in percent."""
    s = F.floor(F.col("similarity_score") * 1000 + 0.5)
    close = neighbours.filter(F.col("rank") <= top).select("customer_id", "similar_customer_id", s.alias("w"))
    weights = close.groupBy("customer_id").agg(F.sum("w").alias("weight"))
    holds = owned.select(F.col("customer_id").alias("similar_customer_id"), "product_id").distinct()
    held = close.join(holds, "similar_customer_id").groupBy("customer_id", "product_id").agg(F.sum("w").alias("held"))
    return held.join(weights, "customer_id").select(
        "customer_id", "product_id",
        half_up(F.coalesce(num("held") * 100 / F.nullif(num("weight"), F.lit(0.0)), F.lit(NEUTRAL_SIMILARITY)), 6).alias("owned_similarity_score"))


def eligibility_score(product: Callable[[str], Column] = F.col) -> Column:
    """100 with factors for score, income and debt against the product's limits, at most 100."""
    need, floor, ceiling = product("min_credit_score"), num(product("min_income")), num(product("max_debt_to_income"))
    credit, income = F.col("credit_score"), F.col("annual_income")
    by_credit = F.when(F.coalesce(need, F.lit(0)) <= 0, 1.0).when(credit < need, 0.3).when(credit >= need + 50, 1.1).otherwise(1.0)
    by_income = F.when(F.coalesce(floor, F.lit(0.0)) <= 0, 1.0).when(income < floor, 0.4).when(income >= floor * 1.5, 1.1).otherwise(1.0)
    by_debt = F.when((F.coalesce(ceiling, F.lit(0.0)) > 0) & (F.col("debt_to_income_ratio") > ceiling), 0.5).otherwise(1.0)
    return F.least(F.lit(100.0) * by_credit * by_income * by_debt, F.lit(100.0))


def confidence_score() -> Column:
    health, used, risk = F.col("health_score"), F.col("utilization_ratio"), F.col("risk_category_encoded")
    return F.least(
        F.lit(50.0) + points((health > 70, 20), (health > 50, 10)) + points((used < 0.3, 15), (used < 0.7, 5))
        + points((risk == 1, 15), (risk == 2, 5)), F.lit(100.0))


def similarity_reasons() -> Column:
    credit = F.col("credit_score")
    found = _phrases(
        2, "; ",
        F.when(credit >= 750, "Excellent credit score").when(credit >= 700, "Good credit score"),
        F.when(F.col("health_score") > 75, "Strong financial health"),
        F.when(F.col("similarity_score") > 70, "Similar customers frequently choose this product"),
        F.when(F.col("annual_income") > 75000, "Income level aligns well"))
    return F.when(found == "", "Profile matches product criteria").otherwise(found)


def scoring_catalogue(products: DataFrame) -> DataFrame:
    return products.filter("is_active").select(
        "product_id", "product_name", "product_type", F.col("minimum_credit_score").alias("min_credit_score"),
        num("minimum_income_required").alias("min_income"), num("maximum_debt_to_income").alias("max_debt_to_income"))


def mixed_score(product: Callable[[str], Column] = F.col) -> Column:
    """The 40/40/20 mix of eligibility, similarity and confidence."""
    return half_up(eligibility_score(product) * 0.4 + F.col("similarity_score") * 0.4 + F.col("confidence") * 0.2, 6)


def _people(features: DataFrame, similarity: DataFrame, owned: DataFrame | None) -> DataFrame:
    """Customers with similarity and confidence, and what they hold as one array, no longer than the catalogue."""
    used = ["customer_id", "credit_score", "annual_income", "health_score", "utilization_ratio", "debt_to_income_ratio",
            "risk_category_encoded"]
    people = features.select(*used).join(similarity, "customer_id", "left").fillna({"similarity_score": NEUTRAL_SIMILARITY})
    if owned is not None:
        held = owned.groupBy("customer_id").agg(F.collect_set("product_id").alias("_held"))
        people = people.join(held, "customer_id", "left")
    return people.withColumn("confidence", confidence_score())


def _not_held(product: Callable[[str], Column] = F.col) -> Column:
    return ~F.coalesce(F.array_contains("_held", product("product_id")), F.lit(False))


def scored_products(features: DataFrame, similarity: DataFrame, products: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Eligibility, similarity, confidence and their 40/40/20 mix for every customer and product.

    Products a customer already holds (``owned``) are left out. They meet the customer as one array before the products
    are paired: the pairs themselves are never shuffled.
    """
    pairs = pair_with(_people(features, similarity, owned), scoring_catalogue(products), "product_id")
    if owned is not None:
        pairs = pairs.filter(_not_held()).drop("_held")
    return pairs.withColumns({"eligibility_score": eligibility_score(), "score": mixed_score()})


def recommend(features: DataFrame, similarity: DataFrame, products: DataFrame, owned: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The n best of ``scored_products`` per customer; equal scores keep type and name order."""
    pairs = first_with(_people(features, similarity, owned), scoring_catalogue(products), "product_id",
                       lambda product: [*falling(mixed_score(product)), product("product_type"), product("product_name"), product("product_id")],
                       n, _not_held if owned is not None else None).drop("_held")
    scored = pairs.withColumns({"eligibility_score": eligibility_score(), "score": mixed_score()})
    top = best_per_customer(
        scored, "customer_id", [F.desc("score"), F.col("product_type"), F.col("product_name"), F.col("product_id")], n)
    return top.withColumns({"reason": similarity_reasons(), "score": half_up(F.col("score"), 1),
                            "confidence": half_up(F.col("confidence"), 1), "max_score": F.lit(100.0)})


def exclude_owned(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """Customer-product pairs without those the customer already holds."""
    held = owned.select("customer_id", "product_id").distinct()
    return pairs.join(held, ["customer_id", "product_id"], "left_anti")


def profile_columns() -> list[Column]:
    return [F.col("annual_income"), F.col("credit_score").cast("int").alias("credit_score"), F.col("health_score"),
            decode_risk(F.col("risk_category_encoded")).alias("risk_category"), F.col("utilization_ratio")]
