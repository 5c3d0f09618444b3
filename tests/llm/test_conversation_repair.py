"""Conversation repair against a plain search over whole suffixes."""

import functools
import hashlib
import zlib

import numpy as np

from companion.llm import conversation_repair as cr
from companion.llm.queries import damaged, op11_conversation_repair

BLANK = " \t\n\x0b\x0c\r"
INF = 10 ** 9


def plain_edits(rows):
    """Least (cost, letters, repaired lines) of (initial, fault, line role, line text) rows."""
    @functools.cache
    def best(i, state, inserted):
        offers = []
        if i == len(rows) and state in ("", "a"):
            offers.append((0, "", ()))
        nxt = "a" if state == "u" else "u"
        if inserted < 2:
            c, s, t = best(i, nxt, inserted + 1)
            offers.append((c + 3, "I" + s, ({"u": "user", "a": "assistant"}[nxt] + ":", *t)))
        if i < len(rows):
            initial, fault, role, text = rows[i]
            c, s, t = best(i + 1, state, 0)
            offers.append((c + 4, "D" + s, t))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                c, s, t = best(i + 1, nxt, 0)
                offers.append((c + 3 + extra, "R" + s, ({"u": "user", "a": "assistant"}[nxt] + ":" + text, *t)))
                if initial == nxt or (initial == "s" and state == ""):
                    c, s, t = best(i + 1, initial, 0)
                    offers.append((c + extra, "K" + s, (role + ":" + text, *t)))
        return min(offers, default=(INF, "", ()))

    for i in range(len(rows), 0, -50):                    # shallow recursion
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def order_key(conv, role, text):
    key = "n" if conv is None else f"v{conv}"
    return hashlib.sha256(f"{key}:{len(role)}:{role}:{text}".encode()).hexdigest()


def plain(rows, damage=True):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    by_conv = {}
    for conv, turn, role, text in rows:
        here = by_conv.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if not damage:
            kind = 9
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, here in by_conv.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, order_key(conv, r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in here:
            end = text.rstrip(BLANK)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen
                          else "truncated" if end[-1] not in ".!?" else "none")
            seen.add((role, text))
        turns = [t for t, _, _ in here if t is not None]
        initials = [r[:1] for _, r, _ in here]
        cost, audit, lines = plain_edits([(i, f, r, t) for i, f, (_, r, t) in zip(initials, faults, here)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_whole_table_whole_and_cut(spark, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    got = op11_conversation_repair(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    assert results(got) == want
    cut = cr.summarize(cr.repair(damaged(small("conversations")), "copies", partitions=61))
    assert results(cut) == want


def test_letters_against_the_plain_search():
    rng = np.random.default_rng(1)
    fault = {"x": "blank"}
    for case in range(1500):
        letters = "".join(rng.choice(list("suaosuuaaSUAx"), rng.integers(1, 12)))
        edits, state = cr.solve(letters, cr.EMPTY, cr.END)
        audit = cr.letters(edits) + "I" * len(cr.CLOSING[state])
        rows = [(c.lower(), fault.get(c, "truncated" if c.isupper() else "none"), "r", str(i))
                for i, c in enumerate(letters)]
        cost, want, _ = plain_edits(rows)
        assert audit == want, (case, letters)
        cuts = sorted(rng.integers(0, len(letters) + 1, 3))
        pieces = [p for p in (letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])) if p]
        following = cr.following_costs([cr.crossing(p) for p in pieces])
        parts, state = "", cr.EMPTY
        for piece, costs in zip(pieces, following):
            edits, state = cr.solve(piece, state, costs)
            parts += cr.letters(edits)
        assert parts + "I" * len(cr.CLOSING[state]) == want, (case, pieces)
        assert cr.crossing(letters)[0:4][state] < INF and min(
            c + e for c, e in zip(cr.crossing(letters)[:4], cr.END)) == cost


def test_survivors_coalesce():
    rng = np.random.default_rng(3)
    for p in ("ua" * 4000, "".join(rng.choice(list("suaSUAox"), 8000)), "s" + "uax" * 3000):
        survivors = cr.Survivors(cr.EMPTY)
        for letter in p:
            survivors.step(letter)
        assert survivors.most < 200
        assert len(survivors.finish(cr.END)[0]) == len(p)


def suffix(survivors, node):
    edits = []
    while node is not survivors.root:
        edits.append(node.edit)
        node = node.parent
    return cr.letters(edits[::-1])


def test_ranks_are_the_order_of_whole_suffixes():
    rng = np.random.default_rng(4)
    for choice in ("suaSUAox", "u", "uA", "o", "ux"):
        survivors = cr.Survivors(cr.EMPTY)
        for letter in rng.choice(list(choice), 300):
            survivors.step(letter)
            by_rank = sorted(survivors.paths.values(), key=lambda path: path[2])
            texts = [suffix(survivors, node) for _, node, _ in by_rank]
            assert texts == sorted(texts) and len(set(texts)) == len(texts)


def test_long_conversations_take_linear_time():
    """Two phases of the same role never coalesce; ties must not cost their whole length."""
    for letters in ("u" * 200_000, "x" * 200_000):
        edits, _ = cr.solve(letters, cr.EMPTY, cr.END)
        assert len(edits) == len(letters)
    assert plain_edits([("u", "none", "user", str(i)) for i in range(60)])[1] == cr.letters(
        cr.solve("u" * 60, cr.EMPTY, cr.END)[0])


def test_a_conversation_with_most_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, ["user", "assistant", "system", "tool"][rng.choice(4, p=[.45, .45, .05, .05])],
             ["Yes.", "no", f"What is {i}?", " "][rng.integers(4)]) for i in range(1500)]
    rows += [(c, i, "user", "Hi!") for c in range(2, 30) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = results(cr.summarize(cr.repair(df, partitions=23)))
    assert got == plain(rows, damage=False) and len(got) == 29


def test_edge_cases(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
            (2, None, "user", None), (2, None, None, "x"), (2, 3, "assistant", ""), (None, 1, "user", "a!"),
            (None, None, "system", "b."), (None, 7, "assistant", "c?"), (3, 5, "", "role without initial."),
            (4, 1, "user", long), (4, 2, "assistant", long + "."), (5, None, None, None), (5, None, None, None),
            (6, 1, "User", "Case."), (7, 1, "système", "é."), (7, 9, "unknown", "日本."), (7, 9, "unknown", "z!"),
            (8, 1, "user", " \t\n\x0b\x0c\r"), (9, 1, "user", "nbsp. "), (10, 2, "assistant", "First.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("copies", "place", "fault", "edit", "same", "letter", "conversation", "piece"):
        df = df.selectExpr("*", f"'x' AS {name}")
    got = results(cr.summarize(cr.repair(df)))
    assert got == plain(rows, damage=False)
    assert got[1][2] == 2 and got[1][6] == "KDDK" and got[5][1] == 2
    edits = {(r.conv_id, r.turn): r for r in cr.repair(df).collect()}
    assert (edits[10, 2].before, edits[10, 2].edit, edits[10, 2].new_role) == ("u", "K", "assistant")
    hurt = cr.summarize(cr.repair(damaged(df), "copies"))
    assert results(hurt) == plain(rows)
    assert cr.summarize(cr.repair(df.limit(0))).count() == 0


def test_conversation_without_rows(spark):
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(drop, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = results(cr.summarize(cr.repair(damaged(df), "copies")))
    assert got == {drop: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
