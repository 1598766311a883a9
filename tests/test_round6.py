"""Findings of round 3, third pass."""

import hashlib

from postlake.llm import fingerprints

PYTHON = {"MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow"}


def python_of_stages(df):
    """The most Python functions that one task of a stage runs side by side, for each stage of a plan."""
    found = []

    def of(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return of(node.initialPlan())
        below = max((of(node.children().apply(k)) for k in range(node.children().size())), default=0)
        if "Exchange" in node.nodeName():
            found.append(below)
            return 0
        return below + (node.nodeName() in PYTHON)

    found.append(of(df._jdf.queryExecution().executedPlan()))
    return found


def test_a_task_of_substring_dedup_needs_one_worker(spark, monkeypatch):
    """Each function more in a stage is a worker more, which stays and takes turns in the stages that follow."""
    plans, commit = [], fingerprints.FingerprintIndex._commit
    monkeypatch.setattr(fingerprints.FingerprintIndex, "_commit", lambda self, rows, name: plans.append(python_of_stages(rows)) or commit(self, rows, name))
    passage = " ".join(f"shared{k}" for k in range(20))
    # Null ids: more than a chunk of hashing.texts, so that rows keep their other columns over several batches.
    rows = [(i, f"own{i} {passage}", f"s{i}") for i in range(9)] + [(None, f"x{i}   {passage}", f"n{i}") for i in range(5000)] + [(None, None, "none"), (None, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    left = fingerprints.remove(docs)
    digests = fingerprints._finished(docs, fingerprints.later_windows(docs, fingerprints.shared_dir(spark)), with_text=False)
    assert len(plans) >= 6
    for stages in (*plans, python_of_stages(left), python_of_stages(digests)):
        assert max(stages) == 1
    want = [rows[0]] + [(i, f"own{i}", f"s{i}") for i in range(1, 9)] + rows[9:-2]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    got = [tuple(r) for r in digests.where("doc_id is null").collect()]
    sha = lambda t: hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest()
    assert sorted(got, key=str) == sorted(((None, len((t or "").split()), 0, sha(t)) for i, t, _ in rows if i is None), key=str)
