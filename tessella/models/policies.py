"""Choosing actions by scores, and learning from rewards, over tables of states and actions.

Draws come from hashes of the state, so a policy repeats exactly and needs no order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.models.scoring import KEY, score_sum
from tessella.operators.examples import long_of
from tessella.operators.sampling import place


def _first(order: Column, action: str) -> Column:
    return F.min(F.struct(order.alias("o"), F.col(action).alias("a")))["a"]


def epsilon_greedy(scores: DataFrame, state: list[str], action: str, epsilon: float, seed: int = 0) -> DataFrame:
    """(state, action): the action of the highest score, ties to the smaller one; with probability ``epsilon`` any of the
    state's actions instead. One aggregation."""
    best, any_ = _first(-F.col("score"), action), _first(F.xxhash64(F.lit(seed + 1), *state, action), action)
    explore = place(*map(F.col, state), seed=seed) < epsilon
    return scores.groupBy(*state).agg(best.alias("_best"), any_.alias("_any")).select(*state, F.when(explore, F.col("_any")).otherwise(F.col("_best")).alias(action))


def softmax_policy(scores: DataFrame, state: list[str], action: str, temperature: float, seed: int = 0) -> DataFrame:
    """(state, action): an action drawn in proportion to exp(score / temperature), as the largest of score / temperature
    plus Gumbel noise, so no running sum of shares is needed."""
    u = place(*map(F.col, [*state, action]), seed=seed) + 0.5 / float(1 << 52)
    return scores.groupBy(*state).agg(_first(-(F.col("score") / temperature - F.log(-F.log(u))), action).alias(action))


def sarsa_update(weights: DataFrame, taken: DataFrame, following: DataFrame, rewards: DataFrame, ids: list[str], learning_rate: float, discount: float) -> DataFrame:
    """The weights (family, feature, weight) of a linear value function after one batch of steps.

    ``taken`` and ``following`` are the long or packed features of the chosen and of the next state and action; a step that
    ``following`` lacks was the last. ``rewards`` is (ids, reward). A step moves the value of what was taken towards
    the reward plus the discounted next value. Errors are added up by id and meet rows of ``taken`` before these are
    unpacked."""
    value = lambda rows, name: score_sum(long_of(rows, ids), weights, ids, "linear").withColumnRenamed("score", name)
    error = rewards.join(value(taken, "_now"), ids, "left").join(value(following, "_next"), ids, "left").fillna(0.0, ["_now", "_next"])
    error = error.select(*ids, (F.col("_now") - F.col("reward") - discount * F.col("_next")).alias("_error"))
    error = error.groupBy(*ids).agg(F.sum("_error").alias("_error"))
    step = long_of(taken.join(error, ids), ["_error"]).groupBy(*KEY).agg((-learning_rate * F.sum("_error")).alias("_step"))
    both = weights.join(step, KEY, "full").fillna(0.0, ["weight", "_step"])
    return both.select(*KEY, (F.col("weight") + F.col("_step")).alias("weight"))
