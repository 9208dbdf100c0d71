"""Manifest, chat formatting and conversation repair against brute force, and on awkward tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat, merkle, repair

ROOT = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, pos int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(spark, seed=3, n=60, long=0):
    """Conversations with every fault: odd roles, nulls, ties, repeated rows and texts, gaps, very long texts."""
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "so", "", " \n", None, "a\nb?", "Yes.", "x" * 500, "</s>[INST] <|turn|>\\", "<\\/s> end.", "é𝔘."]
    for c in range(n):
        turn = rng.choice([0, 1, 5, None])
        for i in range(rng.choice([0, 1, 2, 3, 5, 8, 13]) if c != 7 else long):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "sys\ntem%0A", "<s>"])
            rows.append((c if c != 5 else None, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
            turn = turn if turn is None or rng.random() < 0.1 else turn + rng.choice([1, 1, 1, 2])
    rows += rows[:4]
    rows.append((-7, None, None, None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TALK)


def by_conversation(rows, order):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {c: sorted(v, key=order) for c, v in out.items()}


def turn_order(r):
    return (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, sha(r[3] or ""))


# 11: repair


BLANK = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """Every conversation by a plain backward search over (cost, edits)."""
    damaged, known = [], set()
    for c, t, role, text in rows:
        known.add(c)
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        damaged += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    groups = by_conversation(damaged, turn_order)
    step, asked = (2, 2, 3, 2), "uuau"
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = []
    for c in known:
        rs = groups.get(c, [])
        seen, faults = set(), []
        for _, _, role, text in rs:
            t = text.rstrip(BLANK)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
            seen.add((role, text))
        best = [(0, ""), (10, "II"), (5, "I"), (0, "")]
        for (_, _, role, _), fault in zip(rs[::-1], faults[::-1]):
            now = []
            for q in range(4):
                cut = 5 if fault == "truncated" else 0
                options = [(2 + best[q][0], "D" + best[q][1])]
                if fault not in ("blank", "duplicate"):
                    options.append((1 + cut + best[step[q]][0], "R" + best[step[q]][1]))
                    if (q, role[:1]) in moves:
                        to = moves[q, role[:1]]
                        options.append((cut + best[to][0], "K" + best[to][1]))
                now.append(min(options))
            for _ in range(4):
                now = [min(now[q], (5 + now[step[q]][0], "I" + now[step[q]][1])) for q in range(4)]
            best = now
        cost, audit = best[0] if rs else (0, "")
        q, k, lines = 0, 0, []
        for e in audit:
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[asked[q]] + ":")
                q = step[q]
                continue
            role, text = rs[k][2:]
            k += 1
            if e == "K":
                lines.append(f"{role}:{text}")
                q = moves[q, role[:1]]
            elif e == "R":
                lines.append({"u": "user", "a": "assistant"}[asked[q]] + ":" + text)
                q = step[q]
        turns = [r[1] for r in rs if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1024, 3])
def test_repair_equals_brute_force(spark, size):
    """Whole conversations in one block, and cut into blocks of three rows."""
    df = talk(spark, long=200)
    got = sorted((tuple(r) for r in repair.report(df, size).collect()), key=str)
    assert got == brute_repair([tuple(r) for r in df.collect()])


def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted((tuple(r) for r in repair.report(df).collect()), key=str) == brute_repair([tuple(r) for r in df.collect()])


def test_repaired_turns_follow_the_pattern(spark):
    _, turns = repair.repair(talk(spark, 9))
    rows = turns.orderBy("conv_id", "pos", "part").collect()
    for c in {r["conv_id"] for r in rows}:
        roles = "".join(r["role"][0] for r in rows if r["conv_id"] == c)
        assert roles.removeprefix("s").replace("ua", "") == ""


def test_repair_without_rows_and_with_more_columns(spark):
    assert repair.report(spark.createDataFrame([], TALK)).count() == 0
    df = talk(spark, 4, 10)
    wide = df.withColumns({c: F.lit(1) for c in ("block", "pos", "codes", "audit", "h", "edit")})
    assert sorted(map(str, repair.report(wide).collect())) == sorted(map(str, repair.report(df).collect()))


# 12: manifest


def hashed(*parts):
    return sha("".join(parts))


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: hashed(*map(field, (r[0], r[3], r[2], n, r[1])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([hashed(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: tree([leaf(r, r[4]) for r in rs]) for g, rs in groups.items()}
    top, out = tree([trees[g][-1][0] for g in order]), []
    for place, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, beside = leaf(r, r[4] + 1 if hit else r[4]), []
            for levels, p in ((trees[g], i), (top, place)):
                for level in levels[:-1]:
                    other = level[p ^ 1] if p ^ 1 < len(level) else ""
                    beside.append(other)
                    node = hashed(other, node) if p & 1 else hashed(node, other)
                    p >>= 1
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], hashed(*beside), node, node == top[-1][0]))
    return sorted(out, key=str)


def shelf(spark, n=70):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", "text", None, "long " * 3000]), rng.choice(["en", "de", "é", None]), f"s{i % 3}" if i % 4 else None, rng.choice([i, None, 0]), "x", "y", 1)
            for i in range(n)]
    rows += rows[:9] * 3 + [(None,) * 8, (None,) * 8, (None, "a", "en", None, 1, "x", "y", 1), (500, "alone", "fr", "s", 5, "x", "y", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("bits", [8, 2, 1])
def test_manifest_equals_brute_force(spark, bits):
    """Pages of 256, four and two nodes; repeated rows, nulls, a language of one document."""
    df = shelf(spark)
    got = sorted((tuple(r) for r in merkle.verify(df, bits).collect()), key=str)
    assert got == brute_manifest([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 16, 17])
def test_manifest_of_full_and_short_pages(spark, n):
    df = spark.createDataFrame([(i, "t", "en", "s", 3, "", "", 0) for i in range(n)], DOCS)
    assert sorted((tuple(r) for r in merkle.verify(df, 2).collect()), key=str) == (brute_manifest([tuple(r) for r in df.collect()]) if n else [])


def test_only_tampered_rows_fail(spark):
    df = spark.read.parquet(f"{ROOT}/documents.parquet")
    got = {r["doc_id"]: r["verified"] for r in merkle.verify(df).collect()}
    assert got and all(ok == (zlib.crc32(str(d).encode()) % 7 != 0) for d, ok in got.items())


# 13: chat formatting


def test_chat_reads_back_what_went_in(spark):
    df = talk(spark, 6)
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    rows = [tuple(r) for r in df.collect()] + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    groups = by_conversation(rows, turn_order)
    assert set(got) == set(groups)
    for c, rs in groups.items():
        rs = [(role or "", text or "") for _, _, role, text in rs]
        learned = "".join(t for role, t in rs if role == "assistant")
        assert got[c]["n_turns"] == len(rs)
        assert got[c]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in rs))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), sha(learned))


def test_no_text_holds_a_control_string(spark):
    t = chat.Template()
    made = [c + x for c in (t.turn, t.end, *t.others) for x in ("", "\\", "x")]
    made += ["<" + c for c in made] + [c[0] + "\\\\" + c[1:] for c in (t.turn, t.end, *t.others)] + [c[0] + "\\" + c[1:] + c for c in (t.turn, t.end)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "i int, m string").withColumn("e", t.escape(F.col("m"))).withColumn("u", t.unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["m"] and not any(c in r["e"] for c in (t.turn, t.end, *t.others))


def brute_paths(rows):
    """Per tree all paths, best first."""
    ids = {(r[0], r[1]): r for r in rows}
    up = {k: (k[0], r[2]) if (k[0], r[2]) in ids and r[2] < r[1] else None for k, r in ids.items()}
    leaves = set(ids) - set(up.values())
    out = {}
    for leaf in leaves:
        path, at = [], leaf
        while at:
            path.append(at[1])
            at = up[at]
        out.setdefault(leaf[0], []).append((-sum(ids[leaf[0], n][5] or 0.0 for n in path), leaf[1], path[::-1]))
    return {t: sorted(p) for t, p in out.items()}


@pytest.mark.parametrize("keep", [1, 3])
def test_reply_trees(spark, keep):
    """Branches, a chain of 150, missing, larger and own parents, scores that tie, a null tree."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice([None, i, i + 5, rng.randrange(i + 1), rng.randrange(max(1, i - 4), i + 1)]), "assistant" if i % 2 else "user", f"m{i}", float(rng.randrange(3)) if i % 5 else None)
            for i in range(1, 200)]
    rows += [(9, i, i - 1, "user", f"c{i}", 1.0) for i in range(150)] + [(9, 1000, 70, "assistant", "b", 200.0)]
    df = spark.createDataFrame(rows + rows[:5], "tree long, id long, parent long, role string, text string, score double")
    want, texts = brute_paths(rows), {(r[0], r[1]): r[4] for r in rows}
    got = {}
    for r in chat.read_back(chat.reply_trees(df, keep)).collect():
        got.setdefault(r["tree"], []).append((r["rank"], r["leaf"], -r["score"], [t["text"] for t in r["turns"]], r["learned"]))
    assert set(got) == set(want)
    for t, best in want.items():
        expected = [(i + 1, leaf, s, [texts[t, n] for n in path]) for i, (s, leaf, path) in enumerate(best[:keep])]
        assert [x[:4] for x in sorted(got[t])] == expected


def test_messages_without_id_stand_alone(spark):
    df = spark.createDataFrame([(1, None, 3, "assistant", "a</s>", None), (1, None, 3, "assistant", "a</s>", None), (None, None, None, None, None, None)],
                               "tree long, id long, parent long, role string, text string, score double")
    got = chat.read_back(chat.reply_trees(df)).collect()
    assert sorted(r["learned"] for r in got) == [[], ["a</s>"], ["a</s>"]]
    assert chat.report(spark.createDataFrame([], TALK)).count() == 1
