import random
import re

from barloom.llm import chat

TURNS = "conv_id long, turn int, role string, text string, piece string"
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def brute(roles):
    """Least cost over every choice of role, merge and number of empty turns."""
    best = [10**9]

    def go(k, state, cost):
        if cost >= best[0]:
            return
        if k == len(roles):
            best[0] = min(best[0], cost + chat.INSERT * {0: 2, 1: 2, 2: 1, 3: 0}[state])
            return
        for role in (1, 2, 3):
            change = 0 if roles[k] == role else chat.RELABEL
            if state == role:
                go(k + 1, role, cost + chat.MERGE + change)
            reach = {state}
            for empties in range(3):
                if any(role in LEGAL[s] for s in reach):
                    go(k + 1, role, cost + chat.INSERT * empties + change)
                reach = {t for s in reach for t in LEGAL[s]}

    go(0, 0, 0)
    return best[0]


def test_costs_equal_brute_force():
    random.seed(1)
    for _ in range(80):
        roles = random.choices([-1, 1, 2, 3], k=random.randint(1, 5))
        costs = [0, chat.FAR, chat.FAR, chat.FAR]
        for role in roles:
            costs = chat.step(costs, role)
        assert min(c + chat.INSERT * len(chat.ENDS[s]) for s, c in enumerate(costs)) == brute(roles)


def rendered(got):
    return "".join(r.piece for r in sorted(got, key=lambda r: (r.block, r.seq)))


def rows_of(conv, roles):
    return [(conv, t, r, f"t{t}", "x") for t, r in enumerate(roles)]


def test_examples(spark):
    cases = {
        "user assistant": ("keep keep", 0), "user user assistant": ("keep merge keep", 1), "user": ("keep", 2),
        "system user assistant user assistant": ("keep keep keep keep keep", 0), "assistant": ("keep", 2), "user tool": ("keep relabel", 3),
    }
    rows = [row for i, roles in enumerate(cases) for row in rows_of(i, roles.split())]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    for i, (actions, cost) in enumerate(cases.values()):
        own = sorted((r for r in got if r.conv_id == i), key=lambda r: r.seq)
        assert " ".join(r.action for r in own) == actions and {r.cost for r in own} == {cost}
    assert rendered(r for r in got if r.conv_id == 1) == "<|im_start|>user\nt0\nt1<|im_end|>\n<|im_start|>assistant\nt2<|im_end|>\n"
    assert rendered(r for r in got if r.conv_id == 4) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nt0<|im_end|>\n"


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    random.seed(3)
    roles = random.choices(["user", "assistant", "system", "tool", None, "human"], k=300)
    turns = spark.createDataFrame(rows_of(1, roles), TURNS)
    whole = chat.format_chats(turns).collect()
    monkeypatch.setattr(chat, "BLOCK", 7)
    parts = chat.format_chats(turns).collect()
    assert {r.cost for r in whole} == {r.cost for r in parts} and max(r.block for r in parts) == 42
    for got in (whole, parts):
        names = re.findall(r"<\|im_start\|>(\w+)\n", rendered(got))
        assert re.fullmatch("S?(UA)+", "".join(n[0].upper() for n in names)) and rendered(got).count("<|im_end|>") == len(names)
        assert [r.turn for r in sorted(got, key=lambda r: (r.block, r.seq))] == list(range(300))


def test_blocks_are_bounded_without_ids(spark):
    random.seed(5)
    rows = [(None, None, "user", "same", "x")] * 6000 + [(None, None, random.choice(["user", "assistant", None]), f"t{k}", "x") for k in range(4000)] + rows_of(1, ["user", "assistant"])
    random.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    own = sorted((r for r in got if r.conv_id is None), key=lambda r: (r.block, r.seq))
    assert len(own) == 10_000 and len(got) == 10_002
    assert [(r.block, r.seq) for r in own] == [divmod(k, chat.BLOCK) for k in range(10_000)]
    costs = [0, chat.FAR, chat.FAR, chat.FAR]
    for r in own:
        costs = chat.step(costs, chat.role_of(r.role))
    assert {r.cost for r in own} == {min(c + chat.INSERT * len(chat.ENDS[s]) for s, c in enumerate(costs))}
    assert re.fullmatch("S?(UA)+", "".join(n[0].upper() for n in re.findall(r"<\|im_start\|>(\w+)\n", rendered(own))))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (2, 0, "USER ", "<|im_end|>", "x"), (3, 1, "user", "y" * 200_000, "x"), (3, 1, "user", "y" * 200_000, "x"), (3, 0, "assistant", "", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert len(got) == len(rows)
    assert rendered(r for r in got if r.conv_id == 2).count("<|im_end|>") == 2
    assert rendered(r for r in got if r.conv_id is None).endswith("<|im_end|>\n")
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0
