"""Licence scan, spelling forms and prefix trie against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pytest

from marketframe.llm import op11_license_scan as op11
from marketframe.llm import op12_spelling_forms as op12
from marketframe.llm import op13_prefix_trie as op13

DOCS = "doc_id long, text string, row string, words string"
LOW = str.maketrans(op11.UPPER, op11.LOWER)


def scanned(rows):
    """What the licence scan must give, with every template tried at every place of every text."""
    texts = [re.findall(op11.WORD, (text or "").translate(LOW)) for _, text in rows]
    weights = {w: op11.log(1 + (1 + len(texts)) / (1 + sum(w in t for t in texts))) for w in op11.licence_words()}
    out = []
    for (doc_id, _), words in zip(rows, texts):
        starts, base, labels, best = [], set(), set(), 0.0
        for phrase, label in op11.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            starts += here
            base |= {label} if here else set()
        for t in op11.TEMPLATES:
            told = t.text.split()
            rare = sorted(set(told), key=lambda w: (-weights[w], w))
            rare = rare[:min(op11.RARE, ceil(len(rare) / 2))]
            votes = [(i - j, w) for i, x in enumerate(words) for j, w in enumerate(told) if w in rare and x == w]
            for m in t.must:
                p = m.split()
                at = next(j for j in range(len(told)) if told[j:j + len(p)] == p)
                votes += [(i - at, (m,)) for i in range(len(words)) if words[i:i + len(p)] == p]
            for side in (0, 1):
                slots = defaultdict(set)
                for start, what in votes:
                    slots[(start + side * op11.SLACK) // (2 * op11.SLACK)].add(what)
                for held in slots.values():
                    share = sum(weights[w] for w in held if isinstance(w, str)) / sum(weights[w] for w in rare)
                    if share >= op11.NEED - 1e-12 and all((m,) in held for m in t.must):
                        labels.add(t.label)
                        best = max(best, min(share, 1.0))
        out.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), round(1.0 if starts else best, 9)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((*r[:7], round(r[7], 9)) for r in df.collect()), key=repr)


def test_licence_scan_against_every_place(spark):
    draw = random.Random(3)
    fill = lambda n: " ".join(draw.choice(["the", "of", "und", "la", "mit", "license", "under", "cc", "by", "all", "2", "é"]) for _ in range(n))
    texts = [None, "", "...", "CC-BY", "cc by cc by", "All Rights\tReserved. All rights, reserved", "General public license"]
    for t in op11.TEMPLATES:
        words = t.text.split()
        texts += [f"{fill(30)} {t.text.upper()}. {fill(20)}", f"{fill(5)} {' '.join(words[:len(words) * 2 // 3])} {fill(9)}",
                  " ".join(w for w in words if draw.random() < 0.9), f"{fill(3)} {' '.join(words[:4])} {fill(2)} {' '.join(words[4:])}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (5, texts[8]), (5, texts[8]), (9, fill(4000))]
    got = found(op11.license_scan(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(3)))
    assert got == scanned(rows)
    labelled = {label for r in got for label in r[6].split(",")}
    assert {t.label for t in op11.TEMPLATES} <= labelled and set(op11.BASE.values()) <= labelled


def test_a_template_without_its_phrase_or_out_of_place_is_not_found(spark):
    words = op11.TEMPLATES[2].text.split()
    apart = " ".join(f"{w} x x x x x x x x x x x x x x x x x" for w in words)
    swapped = " ".join(words[::-1])
    got = op11.license_scan(spark.createDataFrame([(1, apart, "", ""), (2, swapped, "", "")], DOCS))
    assert [r.labels for r in got.collect()] == ["", ""]


def test_licence_scan_plan_is_native_and_empty_tables_pass(spark):
    empty = op11.license_scan(spark.createDataFrame([], DOCS))
    assert empty.collect() == []
    docs = spark.createDataFrame([(1, "cc by", "", "")], DOCS)
    looked = op11.looked_up(docs, op11.build_index(dict.fromkeys(op11.licence_words(), 1.0)))
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def forms(rows, least=5):
    """What the spelling forms must be, by comparing words that share a text with one letter deleted or left out."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(op12.LETTER + "+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    counts = {w: n for w, n in counts.items() if n >= least}
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for (_, rest), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b and counts[b] >= 5 * counts[w] else None for w, b in best.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_forms_against_brute_force(spark):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abcdeéß") for _ in range(draw.randrange(6, 11))) for _ in range(40)]
    rows = []
    for i in range(300):
        line = []
        for _ in range(60):
            w = draw.choice(stems[:10] if draw.random() < 0.7 else stems)
            kind, at = draw.random(), draw.randrange(len(w))
            if kind < 0.1:
                w = w[:at] + draw.choice("abcÀ÷") + w[at + (kind < 0.05):]
            elif kind < 0.15:
                w = w[:at] + w[at + 1:]
            line.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i % 250 if i % 17 else None, draw.choice([" ", ", ", "1", "\n"]).join(line)))
    rows += [(1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 4999 + "y"), *[(k, "z" * 3000 + " " + "z" * 2999) for k in range(6)]]
    rows += [(400, "stoneage " * 6 + "stoneagx " * 40 + "stoneayx " * 250)]  # a chain of two steps
    got = op12.spelling_forms(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(4))
    want = forms(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_forms_of_the_given_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = op12.op12_spelling_forms(spark, small)
    assert sorted(map(tuple, got.collect())) == forms([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_chain_of_forms_is_followed_to_its_end(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    got = op12.roots(spark.createDataFrame(steps, "word string, form string"))
    assert {r.root for r in got.collect()} == {"w11"}
    assert op12.spelling_forms(spark.createDataFrame([], DOCS)).collect() == []


def test_spelling_forms_send_no_table_to_the_driver(spark, monkeypatch):
    plans, plain = [], op12.land

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(op12, "land", lambda df: plain(noted(df)))
    rows = [(i, "stoneage stoneagx " * (1 + i % 2) + "stoneagx stoneayx stoneayx " * i, "x", "y") for i in range(30)]
    got = noted(op12.spelling_forms(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == 3 and sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p or "CartesianProduct" in p for p in plans)


@pytest.mark.parametrize("seed", range(6))
def test_findclose_and_ranks(seed):
    rng = np.random.default_rng(seed)
    for pairs in (1, 40, 700, 5000):
        seq, depth, left = [], 0, pairs
        while left or depth:
            if left and (depth == 0 or rng.random() < (0.5 if seed % 2 else 0.9)):
                seq.append(1)
                depth, left = depth + 1, left - 1
            else:
                seq.append(0)
                depth -= 1
        close, stack = {}, []
        for i, b in enumerate(seq):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = op13.Parens(np.array(seq))
        at = np.flatnonzero(tree.opens)
        assert tree.findclose(at).tolist() == [close[i] for i in at.tolist()]
        text = "".join("()"[1 - b] for b in seq)
        assert tree.leaves(at, tree.findclose(at)).tolist() == [text[i:close[i] + 1].count("()") for i in at.tolist()]


TURNS = "conv_id long, turn long, role string, text string, depth string, m string"


def trie(rows):
    """All nodes from all prefixes of all rebuilt conversations."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda v: v[:3])] for c, v in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, saved, leaves, children = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, ms in members.items():
        gain = (len(ms) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += not children[node]
    ends = defaultdict(list)
    for c in sorted(built):
        ends[built[c]].append(str(c))
    return sorted(((min(ms), len(v), min(members[v[:-1]]) if v else None, len(ms), children[v], leaves[v], saved[v],
                    hashlib.sha256(",".join(ends[v]).encode()).hexdigest()) for v, ms in members.items()), key=repr)


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in range(230):
        if c % 20 == 0 and c % 60:
            continue  # families without their first conversation
        n = draw.choice([0, 1, 1, 2, 3, 5, 9])
        rows += [(c, t if draw.random() < 0.98 else None, draw.choice(["user", "user", None]), draw.choice(["a b", "a b", "c\td e", None, "", "f g"])) for t in range(n)]
    rows += [(1000 + k, t, "user", f"turn {t}") for k in range(2) for t in range(1100)]  # a long spine
    return rows + [(None, 0, "user", "left out"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]


@pytest.mark.parametrize("shard_chains", [7, 1 << 18])
def test_trie_against_all_prefixes(spark, shard_chains):
    rows = conversations(shard_chains)
    unique = {}
    for r in rows:  # ties of a turn are ordered by role and a hash: keep one text for each
        unique.setdefault(r[:3], r)
    rows = [*unique.values(), (7, 3, "user", unique[7, 3, "user"][3])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    assert sorted(map(tuple, op13.prefix_trie(df, shard_chains).collect()), key=repr) == trie(rows)


def test_trie_of_the_given_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13.op13_prefix_trie(spark, small).collect()), key=repr) == trie(rows)


def test_trie_of_nothing(spark):
    assert op13.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    alone = op13.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], TURNS))
    assert alone.collect() == []
