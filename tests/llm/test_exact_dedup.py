import hashlib
import re

from dqspark.llm.exact_dedup import exact_dedup

from .helpers import frame, with_clashes

ROWS = [
    (1, "a b"),
    (2, "ab"),
    (3, "a  b"),
    (3, "a  b"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (None, "z"),
    (9, "z"),
    (None, "y"),
    (-(2**63), "n"),
    (2**63 - 1, "n"),
    (7, "x" * 300_000),
    (8, "a b"),
]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        group = [j for j in range(len(rows)) if norm[j] == norm[i]]
        best = min(group, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((doc_id, rows[best][0], len(group), best == i, hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    got = exact_dedup(with_clashes(frame(spark, ROWS))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(ROWS), key=repr)


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
