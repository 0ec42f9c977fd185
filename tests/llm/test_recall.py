"""Recall against brute force with several shards of the configured size, on easy and on hard vectors."""

import numpy as np
import pytest

from tests.llm.test_simhash_and_ann import grouped, table
from tracewell.llm import ann

N, D = 3 * ann.SHARD_ROWS, 64


def made(kind):
    rng = np.random.default_rng(11)
    iso = rng.normal(size=(N, D))
    if kind == "clustered":
        centres = rng.normal(size=(60, D))
        return (centres[rng.integers(60, size=N)] + 0.3 * iso).astype("f4")
    if kind == "norms":
        iso *= rng.uniform(0.2, 2, (N, 1))
    return iso.astype("f4")


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "norms"])
def test_recall_at_shard_size(spark, kind):
    x = made(kind)
    got = grouped(ann.search(table(spark, x), every=100, min_shards=3))
    want = ann.brute_force(x, np.arange(N), every=100)
    recall = np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 20 for k in want])
    print(kind, recall)
    assert got.keys() == want.keys() and recall >= 0.9


def test_the_beam_follows_the_data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, D))
    centres = rng.normal(size=(30, D))
    easy = centres[rng.integers(30, size=1500)] + 0.2 * x
    beams = [ann.Graph(v).measured_beam(v, v[:32], 20) for v in (easy, x)]
    assert beams[0] <= beams[1] <= 1500 and ann.Graph(x[:0]).measured_beam(x[:0], x[:0], 20) == ann.BEAM
