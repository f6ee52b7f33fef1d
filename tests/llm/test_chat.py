import itertools
import random
import re

from basketry.llm import chat as C, registry


def brute(roles):
    """Cheapest cost by trying every way."""
    best = {C.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for n in range(3):
                for ins in itertools.product((1, 2, 3), repeat=n):
                    at, ok = s, True
                    for x in ins:
                        ok, at = ok and x in C.LEGAL[at], x
                    for t in (1, 2, 3):
                        change = 0 if t == r else C.UNNAMED if r == 0 else C.RELABEL
                        for step in [change] * (ok and t in C.LEGAL[at]) + [change + C.MERGE] * (ok and t == at):
                            new[t] = min(new.get(t, C.FAR), c + step + C.INSERT * n)
        best = new
    return min(c + C.INSERT * {C.START: 2, C.SYSTEM: 2, C.USER: 1, C.ASSISTANT: 0}[s] for s, c in best.items())


def cost(rows):
    out = 0
    for r in rows:
        relabel = C.RELABEL if r.role in C.ROLES else C.UNNAMED
        out += C.INSERT * len(r.inserted) + {"keep": 0, "merge": C.MERGE, "relabel": relabel, "relabel_merge": relabel + C.MERGE}[r.action]
    return out


def test_repairs_are_legal_and_cheapest(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.choice(["user", "assistant", "system", None, "tool"]), f"t{k}") for k in range(300)] + [(3, 0, "system", None)]
    rows += [(c, k, rng.choice(["user", "assistant", "system"]), "z") for c in range(4, 30) for k in range(rng.randrange(1, 6))] + [(None, 0, "user", "n"), (40, 1, "user", "same"), (40, 1, "user", "same")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id bigint, turn int, role string, text string, part int, seq string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = C.formatted(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows)
    for conv in {r.conv_id for r in out}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.turn)
        assert cost(mine) == brute([C.ROLES.get(r.role, 0) for r in mine])
        if conv != 40:
            text = "".join(r.rendered for r in mine)
            names = re.findall(r"<\|(system|user|assistant)\|>", text)
            assert re.fullmatch("s?(ua)+", "".join(x[0] for x in names)) and text.count("<|end|>") == len(names) and text.endswith("<|end|>\n")


def test_edges_of_partitions_fix_states():
    rng = random.Random(7)
    for _ in range(200):
        turns = [(c, rng.choice([0, 1, 2, 3])) for c in range(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 9))]
        cuts = sorted(rng.sample(range(1, len(turns)), min(len(turns) - 1, rng.randrange(0, 5)))) if len(turns) > 1 else []
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]

        class E:
            def __init__(self, part, is_first, conv, runs, costs):
                self.part, self.is_first, self.conv, self.runs, self.costs = part, is_first, conv, runs, costs

        edges = []
        for k, p in enumerate(parts):
            runs = C._runs([c for c, _ in p])
            for first, (a, b) in ((True, runs[0]), (False, runs[-1])):
                edges.append(E(k, first, p[a][0], len(runs), sum(C.matrix([r for _, r in p[a:b]]), [])))
        states, total = C.fixed_states(edges), 0
        for k, p in enumerate(parts):
            start, begins, end = states[k]
            runs = C._runs([c for c, _ in p])
            for n, (a, b) in enumerate(runs):
                roles = [r for _, r in p[a:b]]
                last = end if n == len(runs) - 1 else None
                path = C.repair(roles, start if n == 0 else C.START, last)
                total += sum(C.options(r)[x][0] for r, x in zip(roles, path)) + (C.closing(path[-1][1])[0] if last is None else 0)
        assert total == sum(brute([r for c, r in turns if c == conv]) for conv in {c for c, _ in turns})


def test_query(spark, tables):
    turns = registry.table(spark, tables, "conversations")
    assert registry.QUERIES["op7_chat_format"](spark, tables).count() == turns.count()
    assert C.formatted(turns.limit(0)).count() == 0
