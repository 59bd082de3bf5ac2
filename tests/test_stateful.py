"""Streams that keep state between micro-batches, against plain Python and under repeated micro-batches."""

import hashlib

import pytest

from corpuswright.operators.mixing import interleave
from corpuswright.session import work_dir
from corpuswright.streaming import streams as W


def uniform(seed, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 4294967296


def as_stream(spark, batches, schema):
    path = work_dir(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return W.stream_source(spark, "web", path, schema, files_per_trigger=1)


def test_buffer_shuffle_is_the_plain_one(spark):
    schema = "k long, t string, last boolean"
    batches = [[(k, f"t{k}", False) for k in range(a, b)] for a, b in ((0, 3), (3, 60), (60, 61), (61, 90))]
    batches[1][5] = (8, None, None)
    batches.append([(89, None, True)])
    batches.append([(k, f"t{k}", False) for k in range(200, 230)] + [(229, None, True)])
    shuffled = W.stream_shuffle_buffer(as_stream(spark, batches, schema), "k", ["t"], 7, 6, shards=2, last="last")
    got = sorted(tuple(r) for r in spark.read.parquet(W.run_to_table(shuffled, "shuffle")).collect())
    want = []
    for shard in (0, 1):
        held, sent = [], 0
        for rows in batches:
            for k, t, end in sorted(rows, key=lambda r: (bool(r[2]), r[0])):
                if end:
                    out = sorted(held, key=lambda r: (uniform(7, "end", r[0]), r[0]))
                    held = []
                elif int(uniform(7, "shard", k) * 2) != shard:
                    continue
                elif len(held) < 6:
                    held.append((k, t))
                    continue
                else:
                    at = int(uniform(7, "slot", k) * 6)
                    out, held[at] = [held[at]], (k, t)
                want += [(shard, sent + j, *r) for j, r in enumerate(out)]
                sent += len(out)
    assert got == sorted(want, key=lambda r: r[:2])
    # rows of different micro-batches meet
    first = [r[2] for r in got if r[2] < 90]
    assert first != sorted(first)


SCHEMA = "k long, s string, last boolean"


def _sources():
    rows = {"a": list(range(0, 90, 3)), "b": list(range(1, 40, 3)), "c": list(range(2, 200, 3))}
    everything = sorted((k, s, False) for s, own in rows.items() for k in own)
    return rows, everything


@pytest.mark.parametrize("cuts", [(5, 6, 60), (1,), ()])
def test_a_streamed_mixture_is_the_finite_one(spark, cuts):
    rows, everything = _sources()
    ends = {s: max(own) for s, own in rows.items()}
    batches = [everything[a:b] for a, b in zip((0, *cuts), (*cuts, len(everything)))]
    # a source may end before the others do: `b` is marked in the micro-batch of its last row
    for own in batches:
        if any(k == ends["b"] for k, *_ in own):
            own.append((ends["b"], "b", True))
    batches.append([(ends["a"], "a", True), (ends["c"], "c", True)])
    names, probs = ["a", "b", "c"], [0.5, 0.2, 0.3]
    path = W.stream_interleave(as_stream(spark, batches, SCHEMA), "k", names, probs, 3, "s", "last")
    got = sorted((r["draw"], r["s"], r["k"]) for r in spark.read.parquet(path).collect())
    finite = interleave(spark.createDataFrame(everything, SCHEMA).drop("last"), "k", names, probs, 3, "s")
    assert got == sorted((r["draw"], r["s"], r["k"]) for r in finite.collect())
    # more than one micro-batch took part
    if len(cuts) > 1:
        assert spark.read.parquet(path).select("batch_id").distinct().count() > 1


def test_a_source_without_rows_is_an_error(spark):
    batches = [[(1, "a", False), (1, "a", True), (1, "b", True)]]
    with pytest.raises(Exception, match="sources without rows"):
        W.stream_interleave(as_stream(spark, batches, SCHEMA), "k", ["a", "b"], [0.5, 0.5], 3, "s", "last")


def test_metric_log_against_plain_python(spark):
    schema = "k long, phase string, metric string, value double, log boolean"
    rows = []
    for k in range(120):
        phase = ["train", "eval", None][k % 7 % 3]
        rows.append((k, phase, None, None, True) if k % 11 == 4 else (k, phase, f"m{k % 4}", None if k % 13 == 0 else float(k), [False, None][k % 2]))
    batches = [rows[:2], rows[2:70], rows[70:71], rows[71:]]
    path = W.stream_metric_log(as_stream(spark, batches, schema), "k", "phase", "metric", "value", "log")
    got = {(r["phase"], r["log_no"], r["metric"]): (r["mean"], r["records"]) for r in spark.read.parquet(path).collect()}
    want, open_, logs = {}, {}, {}
    for _, phase, metric, value, log in rows:
        if log:
            for (p, m), values in list(open_.items()):
                if p == phase:
                    known = [v for v in values if v is not None]
                    want[(p, logs.get(p, 0), m)] = (sum(known) / len(known) if known else None, len(known))
                    del open_[(p, m)]
            logs[phase] = logs.get(phase, 0) + 1
        else:
            open_.setdefault((phase, metric), []).append(value)
    assert got.keys() == want.keys()
    for key, (mean, n) in want.items():
        assert got[key][1] == n and (got[key][0] == pytest.approx(mean) if n else got[key][0] is None)
