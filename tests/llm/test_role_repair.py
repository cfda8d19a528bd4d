import itertools
import random
import re

from driftlake.llm import role_repair as rr

COLUMNS = "conv_id long, turn long, role string, text string, cost string"


def cheapest(roles):
    """Brute force over every sequence of choices."""
    best = None
    given = [rr.role_code(r) for r in roles]
    for path in itertools.product(*[rr._BY_ROLE[g] for g in given]):
        state, cost = rr.START, 0
        for a, b, c, _, _ in path:
            if a != state:
                break
            state, cost = b, cost + c
        else:
            cost += {rr.START: 0, rr.SYSTEM: 4, rr.USER: 2, rr.ASSISTANT: 0}[state]
            best = cost if best is None else min(best, cost)
    return best


def test_cost_is_least_and_result_legal(spark):
    rng = random.Random(3)
    talks = {i: [rng.choice(["user", "assistant", "system", "Human ", None, "tool"]) for _ in range(rng.randrange(1, 6))] for i in range(60)}
    rows = [(i, k, r, f"t{k}", "x") for i, rs in talks.items() for k, r in enumerate(rs)]
    out = rr.repair(spark.createDataFrame(rows, COLUMNS)).collect()
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    assert len(out) == len(rows)
    for i, rs in talks.items():
        mine = sorted(by[i], key=lambda r: r.turn)
        assert sum(r.cost for r in mine) == cheapest(rs), rs
        legal("".join(r.rendered for r in mine))


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    assert re.fullmatch(r"S?(UA)+", "".join(r[0].upper() for r in roles)), roles
    assert text.count("<|im_end|>\n") == len(roles) and text.endswith("<|im_end|>\n")
    return roles


def test_one_long_dialogue_spans_tasks(spark):
    rng = random.Random(4)
    roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(3000)]
    rows = [(7, k, r, str(k), None) for k, r in enumerate(roles)] + [(8, 0, "user", "q", None), (None, 0, "user", None, None), (6, None, "assistant", "a", None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = rr.repair(docs)
        assert out.rdd.getNumPartitions() > 1
        out = [r for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    mine = sorted((r for r in out if r.conv_id == 7), key=lambda r: r.turn)
    codes = [rr.role_code(r) for r in roles]
    assert sum(r.cost for r in mine) == (rr._stretch(codes)[rr.START] + rr._END).min()
    text = "".join(r.rendered for r in mine)
    legal(text)
    assert re.findall(r"\d+", text) == [str(k) for k in range(3000)]
    for other in (8, None, 6):
        legal("".join(r.rendered for r in out if r.conv_id == other))


def test_ties_and_empty(spark):
    rows = [(1, 0, "user", "a", None)] * 3
    out = rr.repair(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [r.action for r in out] == ["keep", "merge", "merge"] and sum(r.cost for r in out) == 2 * rr.MERGE + rr.INSERT
    assert rr.repair(spark.createDataFrame([], COLUMNS)).collect() == []
