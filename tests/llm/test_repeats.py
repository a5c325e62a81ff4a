"""Conversation repair, passages and spelling variants against brute force; and their defined edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest

from sigloom.llm import repair, spelling, substring

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_tasks(spark):
    """Small tables are spread over seven tasks of each shuffle, so that groups go on from task to task."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


# Conversation repair


def cheapest(codes):
    """Cost and audit by a table of the best repair for each state, row by row."""

    def inserted(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                best[repair.WANTED[q]] = min(best.get(repair.WANTED[q], (99999, "")), (c + 3, a + "I"))
        return best

    best = {0: (0, "")}
    for code in codes:
        following = {}
        for q, (c, a) in inserted(best).items():
            ways = [(q, c + 4, a + "D")]
            if not code & repair.GO:
                more = 3 if code & repair.TRUNCATED else 0
                ways.append((repair.WANTED[q], c + 3 + more, a + "R"))
                if q in repair.KEPT[code & 3]:
                    ways.append((repair.KEPT[code & 3][q], c + more, a + "K"))
            for to, cost, audit in ways:
                following[to] = min(following.get(to, (99999, "")), (cost, audit))
        best = following
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def test_shortest_paths_against_a_table():
    rng = random.Random(1)
    for _ in range(1500):
        codes = bytes(rng.choice([0, 1, 2, 2, 3, 3]) | rng.choice([0, 0, 0, repair.GO, repair.TRUNCATED]) for _ in range(rng.randint(0, 12)))
        assert (repair.distances(codes)[0], repair.solve(codes)) == cheapest(codes)


def plainly_repaired(rows):
    """conv_id -> the query's values, from (conv_id, turn, role, text) in order."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        codes, seen, counts = [], set(), Counter()
        for _, role, text in own:
            shown = text.strip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            codes.append(max(" sua".find(role[:1]), 0) * (role != "") | {"blank": 4, "duplicate": 4, "truncated": 8}.get(fault, 0))
        cost, audit = cheapest(codes)
        lines, at, last = [], 0, ""
        for edit in audit:
            wanted = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{wanted}:")
                last = wanted[0]
                continue
            if edit != "D":
                role = own[at][1] if edit == "K" else wanted
                lines.append(f"{role}:{own[at][2]}")
                last = role[0]
            at += 1
        turns = {t for t, _, _ in own if t is not None}
        firsts = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def summarised(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {(None if r["conv"] == "" else int(r["conv"][1:])): tuple(r[n] for n in names) for r in df.collect()}


def test_conversations_over_many_tasks(many_tasks):
    """One conversation has most of all rows and goes on over all tasks."""
    rng = random.Random(2)
    says = lambda i: rng.choice(["", " \t", "yes", f"Turn {i}.", f"cut {i}", f"Why {i}?", "same."])
    rows = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), says(i)) for i in range(900)]
    rows += [(c, i, rng.choice(["user", "assistant", "system"]), says(i)) for c in range(2, 40) for i in range(0, rng.randint(1, 9), rng.choice([1, 2]))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = summarised(repair.summaries(repair.repair(many_tasks.createDataFrame(shuffled, TURNS).repartition(5))))
    assert got == plainly_repaired(sorted(rows, key=lambda r: r[:2]))


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "Of no conversation."), (None, None, "assistant", "Nor of a turn."), (3, None, None, None), (3, 1, "", "no role."), (4, 5, "user", "twice."), (4, 5, "user", "twice."),
        (4, 9, "assistant", "x" * 200_000 + "\n \t"), (5, 2, "système", "Été !"), (5, 3, "user", "日本。"), (5, 4, "assistant", "ok?"),
    ]
    frame = spark.createDataFrame([(*r, "other") for r in rows], TURNS + ", fault string")
    in_order = sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0))
    assert summarised(repair.summaries(repair.repair(frame))) == plainly_repaired(in_order)
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0 and repair.digest(none, repair.summaries(repair.repair(none))).count() == 0


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = spark.createDataFrame([(c, t, "assistant", f"Text {c} of {t}!") for c in [*range(60), None] for t in [0, 1, None]], TURNS)
    import zlib

    want = []
    for c, t, role, text in (tuple(r) for r in rows.collect()):
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            own = (c, t, "user" if kind == 4 else role, {1: "", 2: text.replace("!", "")}.get(kind, text))
            want += [own, own] if kind == 3 else [own]
    assert sorted(map(str, (tuple(r) for r in repair.damaged(rows).collect()))) == sorted(map(str, want))
    only = spark.createDataFrame([(next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "gone")], TURNS)
    done = repair.digest(only, repair.summaries(repair.repair(repair.damaged(only)))).collect()
    assert [(r["cost"], r["audit"], r["repaired_sha256"]) for r in done] == [(0, "", hashlib.sha256(b"").hexdigest())]


def test_messages_keep_what_is_not_edited(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi!"), (1, 1, "user", " "), (1, 2, "tool", "Done."), (1, 3, "user", "More?")], TURNS)
    got = [(r["edit"], r["role"], r["text"], r["fault"]) for r in repair.repair(rows).collect()]
    assert got == [("K", "user", "Hi!", 0), ("D", None, None, 1), ("R", "assistant", "Done.", 0), ("I", "user", "", 0), ("R", "assistant", "More?", 0)] or "".join(x[0] for x in got) == cheapest([2, 6, 0, 2])[1]


# Passages


@pytest.mark.parametrize("period", range(1, 32))
def test_difference_covers(period):
    cover = substring.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) == {7: 3, 13: 4, 21: 5, 31: 6}.get(period, len(cover))


def without_repeats(rows, width):
    """(id, text) -> kept words, n_removed; ids None come first and are one document."""
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for p in range(len(words) - width + 1):
            w = tuple(words[p : p + width])
            first[w] = min(first.get(w, 1 << 70), -(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = {q for p in range(len(words) - width + 1) if first[tuple(words[p : p + width])] < (-(1 << 63) if i is None else i) for q in range(p, p + width)}
        out.append((i, len(words), len(gone), " ".join(w for q, w in enumerate(words) if q not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "period"), [(6, 1), (6, 4), (9, 7), (12, 12)])
def test_passages_against_brute_force(many_tasks, width, period):
    rng = random.Random(width * 100 + period)
    passages = [[f"p{j}" if rng.random() < 0.7 else rng.choice("abc") for j in range(rng.randint(4, 40))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        rows.append((i * 3 % 151, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(i, " ".join(passages[0])) for i in range(1000, 1100)]  # copies of one text
    docs = many_tasks.createDataFrame(rows, DOCS).repartition(6)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"] or ""))) for r in substring.dedup_passages(docs, width=width, period=period).collect()]
    assert sorted(got, key=str) == without_repeats(rows, width)


def test_odd_passages(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    fifty = " ".join(f"x{i}" for i in range(50))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (None, fifty), (None, fifty + " more"), (4, fifty.replace(" ", "\n")), (5, "Before  " + fifty + "\nbehind\t it "), (6, long), (7, "a " + long),
        (7, "a " + long), (8, fifty[:-1]), (9, " ".join(fifty.split()[:49])), (10, "né 日本 " + fifty + " 😀"), (-(2**62), "first of all"),
    ]
    frame = spark.createDataFrame([(*r, "kept", 5) for r in rows], DOCS + ", _hx string, n_words int")
    done = substring.dedup_passages(frame)
    assert done.columns == ["doc_id", "text", "_hx", "n_words", "n_removed"] or set(done.columns) == {"doc_id", "text", "_hx", "n_words", "n_removed"}
    found = done.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"] or ""))) for r in found), key=str) == without_repeats(rows, 50)
    assert {r["text"] for r in found if r["doc_id"] == 5} == {"Before  behind\t it "} and {r["text"] for r in found if r["doc_id"] == 1} == {None}
    assert {r["_hx"] for r in found} == {"kept"}
    assert substring.dedup_passages(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="period"):
        substring.repeats(frame, width=5, period=6)


# Spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if n >= min_count}
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: (lambda b: b if b and words[b] >= ratio * words[w] else None)(min(links[w], key=lambda v: (-words[v], v), default=None)) for w in words}
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], words[w], len(links[w]), words[form[w]] if form[w] else None) for w in words}


@pytest.mark.parametrize("block", [3, 4096])
def test_variants_against_brute_force(spark, monkeypatch, block):
    """Few letters, so that bands are shared by many words; with small blocks they are divided."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    counts = {"".join(rng.choice("abeéÀß") for _ in range(rng.randint(6, 8))): rng.choice([1, 4, 5, 6, 30, 31, 200, 5000]) for _ in range(350)}
    for w in list(counts)[:120]:
        i = rng.randint(0, len(w) - 1)
        counts[rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "ÿ" + w[i + 1 :]])] = rng.choice([5, 7, 40, 1000])
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(table).collect()}
    assert got == grouped(counts)


def test_masks_and_bands(spark):
    """One edit flips at most two bits, so one band stays."""
    rng = random.Random(5)
    letters = spelling.LETTERS + "éÀßÿÖñ÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", spelling.mask(spelling.F.col("word")).alias("m")).collect()
    for r in rows:
        m = 0
        for c in r["word"]:
            m ^= 1 << spelling.bit_of(c)
        assert r["m"] % (1 << 64) == m
    assert sum(spelling._BAND_MASKS) == (1 << 64) - 1


def test_odd_texts_of_words(spark):
    rows = [(None, "Färben färben FÄRBEN färben färben"), (1, None), (2, ""), (3, "12345 ... "), (4, ("garden " * 60 + "gardan " * 3 + "Garden-gardan ") * 2), (4, "garden"), (4, "garden"), (5, "x" * 100_000), (6, "naïveté " * 5)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], DOCS + ", word string")
    counts = Counter()
    for _, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        counts.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", lowered) if len(w) >= 6)
    assert {tuple(r) for r in spelling.words(docs).collect()} == set(counts.items())
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.group(docs).collect()}
    assert got["gardan"] == ("garden", 1) and got["garden"] == (None, 1) and "x" * 100_000 not in got
    assert spelling.group(spark.createDataFrame([], DOCS)).count() == 0


def test_slips(spark):
    import zlib

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(7)) for _ in range(2000)]
    docs = spark.createDataFrame([(7, " ".join(words)), (None, " ".join(words))], DOCS)
    want = Counter()
    for i in ("7", ""):
        for w in words:
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[: h % 7] + w[h % 7 + 1 :] if h % 199 == 0 else w
            want[w] += 1
    assert {tuple(r) for r in spelling.words(docs, slip=199).collect()} == set(want.items())
    assert any(len(w) == 6 for w in want)
