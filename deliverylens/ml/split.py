"""Deterministic train/test splits (ML1, ML7).

Membership comes from an md5 of the event id, so it is the same on every
run, in every engine and after any executor loss; all rows of one event
land on the same side.  Both splits have exact shares, found by a distributed
rank search over the hashes: the label split (ML1) for each label (it salts
the hash, so the two are independent), the event split (ML7) for all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import order_statistics

SALT = "label:"


def event_hash(col: str = "event_id", salt: str = "") -> Column:
    """48 bits of a salted md5 (exact as a double)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(col))), 1, 12), 16, 10).cast("long")


def label_hash(col: str = "event_id") -> Column:
    return event_hash(col, SALT)


def stratified_split(features: DataFrame, test_fraction: float = 0.2, label: str = "is_recovered",
                     labels: tuple[int, ...] = (0, 1)) -> DataFrame:
    """ML1: adds ``split`` ('train' / 'test').  Of each label the rows with the
    smallest hashes, ``floor(n * test_fraction + 0.5)`` of them (and the rest
    of the last event's), are for test; rows with another label are for
    training.  The hash at that rank is found by an exact distributed rank
    search when the split is made."""
    per_label = features.select(*[F.when(F.col(label) == y, label_hash()).alias(f"h{y}") for y in labels])

    def last(n: int) -> list[int]:
        k = math.floor(n * test_fraction + 0.5)
        return [k - 1] if k else []

    _, cuts = order_statistics(per_label, per_label.columns, last)
    test = F.lit(False)
    for (name, _), cut in cuts.items():
        test = test | ((F.col(label) == int(name[1:])) & (label_hash() <= F.lit(int(cut))))
    return features.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def shuffle_split(events: DataFrame, train_fraction: float = 0.8) -> DataFrame:
    """ML7: the event-level 80/20 split (no label involved): ``floor(n *
    train_fraction)`` rows are for training, those with the largest hashes;
    rows with the hash of the last test row are for test too."""
    _, cuts = order_statistics(events.select(event_hash().alias("h")), ["h"],
                               lambda n: [n - math.floor(n * train_fraction) - 1] if n > math.floor(n * train_fraction) else [])
    test = F.lit(False)
    for cut in cuts.values():  # one number
        test = event_hash() <= F.lit(int(cut))
    return events.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
