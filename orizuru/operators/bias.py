"""Separate user bias from item bias: score = mean + b_u + b_i, by regularised alternating updates.

Duplicate ratings count each; null and NaN scores are left out; an empty table raises, as a mean is then undefined.
The ratings are first summed by (user, item), so an iteration shuffles at most one row per pair, and a user or item
with a third of all ratings is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orizuru.session import cut, laid_out

ROUNDS_A_CUT = 1  # longer plans cost more to make than a small table of biases to write

def residuals(ratings: DataFrame) -> tuple[DataFrame, float, int]:
    """(user_id, item_id, n, s, s2): count, sum and square sum of score - mean; the mean; the number of ratings."""
    valid = ratings.where(F.col("score").isNotNull() & ~F.isnan("score"))
    head = valid.agg(F.avg("score").alias("mean"), F.count("*").alias("n")).first()
    if not head.n:
        raise ValueError("no ratings to fit")
    r = F.col("score") - F.lit(head["mean"])
    pairs = valid.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("s2"))
    return pairs, head["mean"], head.n


def _laid(pairs: DataFrame, key: str, other: str, n: int) -> tuple[DataFrame, list]:
    """The pairs laid out by `key`, and the hot keys, which are salted by the other side: those with more pairs than a
    partition's share of all n ratings, so at most as many as there are partitions."""
    parts = _parts(pairs)
    hot = [r[0] for r in pairs.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") * parts > n).select(key).collect()]
    if not hot:
        return laid_out(pairs, key), hot
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(other), F.lit(parts))).otherwise(0).cast("int")
    return laid_out(pairs.withColumn("salt", salt), key, "salt"), hot


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _step(laid: DataFrame, hot: list, known: DataFrame | None, key: str, other: str, regular: float) -> DataFrame:
    """New biases of `key`; `laid` holds the pairs by `other` (and salt, where some are `hot`), so that the biases come
    to them and no pair moves."""
    b = "b_u" if key == "user_id" else "b_i"
    if known is None:
        part = laid.withColumn("d", F.col("s"))
    else:
        old, keys = "b_i" if b == "b_u" else "b_u", [other]
        if hot:
            last = F.when(F.col(other).isin(hot), _parts(laid) - 1).otherwise(0)
            known, keys = known.select(other, old, F.explode(F.sequence(F.lit(0), last)).alias("salt")), [other, "salt"]
        # the small side is hashed, so that the pairs are sorted in no round
        part = laid.join(known.select(*keys, old).hint("shuffle_hash"), keys).withColumn("d", F.col("s") - F.col("n") * F.col(old))
    sums = part.groupBy(key).agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return sums.select(key, (F.col("d") / (F.col("n") + F.lit(float(regular)))).alias(b), "d", "n")


def _round_loss(squares: float, own: DataFrame, users: DataFrame, items: DataFrame, lambda_user: float, lambda_item: float) -> float:
    """Square errors and regularisation of the biases of a round, without its pairs: each user's and item's share of it hangs on sums by user (`own`:
    of n and s) and on those that the item's bias was made of, as d there leaves the users' biases out already."""
    u, i = F.col("b_u"), F.col("b_i")
    of_users = users.select("user_id", "b_u").join(own.hint("shuffle_hash"), "user_id").agg(F.sum(u * u * (F.col("n_u") + lambda_user) - 2 * u * F.col("s_u"))).first()[0]
    return squares + of_users + items.agg(F.sum(i * i * (F.col("n") + lambda_item) - 2 * i * F.col("d"))).first()[0]


def fit(ratings: DataFrame, max_iter: int = 40, tol: float | None = 1e-5, lambda_user: float = 10.0, lambda_item: float = 10.0) -> dict:
    """users (user_id, b_u), items (item_id, b_i), mean, losses. Stops once the loss changes by less than `tol`;
    with tol None all `max_iter` rounds run and no loss is computed before the last.

    The pairs are laid out twice, by user and by item, hot ones salted, and read once each in a round; the loss is taken from the sums by user and
    by item. The lineage is cut after each round where the loss is asked for, which reads both biases, and every `ROUNDS_A_CUT` rounds where
    it isn't."""
    pairs, mean, n = residuals(ratings)
    pairs = cut(pairs)
    own = cut(pairs.groupBy("user_id").agg(F.sum("n").alias("n_u"), F.sum("s").alias("s_u"), F.sum("s2").alias("s2")))
    squares = own.agg(F.sum("s2")).first()[0]
    pairs = pairs.drop("s2")
    by_user, by_item = _laid(pairs, "user_id", "item_id", n), _laid(pairs, "item_id", "user_id", n)
    items, losses = None, []
    for k in range(max_iter):
        last = k == max_iter - 1
        users = _step(*by_item, items, "user_id", "item_id", lambda_user)
        if tol is not None or last:
            users = cut(users)
        items = _step(*by_user, users, "item_id", "user_id", lambda_item)
        if tol is not None or last or k % ROUNDS_A_CUT == ROUNDS_A_CUT - 1:
            items = cut(items)
        if tol is not None or last:
            losses.append(_round_loss(squares, own, users, items, lambda_user, lambda_item))
        if tol is not None and len(losses) > 1 and abs(losses[-2] - losses[-1]) < tol:
            break
    users, items = users.select("user_id", "b_u"), items.select("item_id", "b_i")
    return {"users": users, "items": items, "mean": mean, "n": n, "losses": losses}


def predict(pairs: DataFrame, model: dict) -> DataFrame:
    """`pairs` (user_id, item_id, ...) with the predicted score; unknown users and items have bias 0."""
    b = F.coalesce("b_u", F.lit(0.0)) + F.coalesce("b_i", F.lit(0.0))
    return pairs.join(model["users"], "user_id", "left").join(model["items"], "item_id", "left").withColumn("predicted", F.lit(model["mean"]) + b).drop("b_u", "b_i")
