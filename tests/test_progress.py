import random

import pytest

from marginalia.streaming import progress as P

SCHEMA = "seq bigint, path string, stage string, part int, parts int, pages int, pages_done int"


def walk(rows):
    """The fold, event by event."""
    state = {}
    for seq, path, stage, part, parts, pages, done in sorted(rows):
        s = state.setdefault(path, {"stage": "unknown", "parts": None, "converted": set(), "pages": {}})
        if done is not None:
            s["pages"][part or 0] = max(s["pages"].get(part or 0, 0), done)
        if stage is None:
            continue
        if stage == "converted":
            if part is not None:
                s["converted"].add(part)
            if s["parts"] and len(s["converted"]) < s["parts"]:
                continue
        if s["stage"] == "failed" and stage not in ("queued", "skipped"):
            continue
        if stage == "queued":
            s["converted"], s["pages"] = set(), {}
        s["stage"] = stage
    return {p: (s["stage"], sum(s["pages"].values())) for p, s in state.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_without_parts_known_late(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for seq in range(300):
        stage = rnd.choice(["queued", "skipped", "converting", "converted", "failed", "done", None, None])
        rows.append((seq, f"p{rnd.randint(0, 9)}", stage, rnd.choice([0, 1, None]), None, None, rnd.randint(1, 9) if stage is None else None))
    got = {r.path: (r.stage, r.pages_done) for r in P.file_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == walk(rows)


def test_gates(spark):
    def stage(*events):
        rows = [(i, "p", s, part, parts, None, None) for i, (s, part, parts) in enumerate(events)]
        return P.file_states(spark.createDataFrame(rows, SCHEMA)).first().stage

    assert stage(("queued", None, 2), ("converting", None, None), ("converted", 0, None), ("converted", 0, None)) == "converting"
    assert stage(("queued", None, 2), ("converted", 0, None), ("converted", 1, None)) == "converted"
    assert stage(("converting", None, None), ("failed", 0, None), ("converted", 1, None)) == "failed"
    assert stage(("failed", None, None), ("queued", None, None)) == "queued"


def test_parse_and_counts(spark):
    lines = spark.createDataFrame([('{"ts": 1, "path": "a", "pages_done": 3}',), ("",), ("{broken",), ("[1]",), ("7",)], "value string")
    assert [(r.path, r.pages_done) for r in P.parse(lines).collect()] == [("a", 3)]
    counts = P.stage_counts(spark.createDataFrame([("done",), ("done",)], "stage string"))
    assert {r.stage: r.files for r in counts.collect()} == {**dict.fromkeys(P.STAGES, 0), "done": 2}
    assert P.file_states(spark.createDataFrame([], SCHEMA)).count() == 0
