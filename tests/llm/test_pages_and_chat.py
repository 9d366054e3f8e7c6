"""Chat tree, URL filter and main text: contracts, round trips, brute force and defined cases."""

import hashlib
import html
import itertools
import random
import time
from collections import Counter
from math import log

import duckdb
import pytest

from marketframe.llm import html_blocks
from marketframe.llm import op01_chat_tree as op1
from marketframe.llm import op03_url_filter as op3
from marketframe.llm import op09_main_text as op9

SMALL = "/root/testdata/sf0.001"
TRICKY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> <s", "a\\", "<<SYS>><</SYS>><<s>", "[[INST]", "<|role|>x<|text|>", "", "<", "</s", "[\\/INST]", "é\n"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "<|text|>", "[INST]"])
def test_segments_are_read_back(role):
    for text in TRICKY:
        before, body, after = op1.segment(role, text)
        assert op1.unescape(body) == text and not op1._MARK.search(body) and op1.read_back(before + body + after) == (role, text)


TURNS = "conv_id long, turn int, role string, text string, key string, idx string, parent int"


@pytest.fixture(scope="module")
def turns(spark):
    shared = [("system", "be kind"), ("user", "hello there")]
    talks = [[*shared, ("assistant", "hi")], [*shared, ("assistant", "hi"), ("user", "more")], [*shared, ("assistant", "other")], [shared[0]], [*shared, ("assistant", "hi")],
             [(None, None), ("assistant", None)], [("user", t) for t in TRICKY], [("assistant", t) for t in TRICKY], [("tool", "x")] * 2]
    rows = [(i, t, role, text, "k", "i", 1) for i, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    rows += [(20, None, "user", "b", "", "", 0), (20, None, "user", "a", "", "", 0), (20, 1, "assistant", "c", "", "", 0), (20, 1, "assistant", "c", "", "", 0),
             (None, 0, "user", "no id", "", "", 0)]
    return rows, spark.createDataFrame(rows, TURNS)


def test_digests_of_odd_turns(spark, folder, turns):
    rows, df = turns
    got = {r.conv_id: r for r in op1.op1_chat_tree(spark, folder(conversations=df)).collect()}
    said = "</s>[INST] ok [/INST]"
    rows = [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {r[0] for r in rows}
    for conv_id, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, *_ in rows if c == conv_id))
        learned = "".join(text for _, _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == sum(len("".join(op1.segment(role, text))) for _, _, role, text in own)
    assert op1.op1_chat_tree(spark, folder(conversations=df.limit(0))).count() == 1
    assert op1.prefix_tree(op1.chained(df.limit(0))).count() == 0


@pytest.mark.parametrize("shard_tokens", [40, 1 << 20])
def test_tree_shares_turns_and_attends_to_ancestors(turns, shard_tokens):
    rows, df = turns
    chain = op1.chained(df)
    tree = op1.prefix_tree(chain, shard_tokens).toPandas()
    decode = op1.encoder(op1.tokenizer_path()).decode
    if shard_tokens > 40:
        assert len(tree) == chain.select("key").distinct().count() < chain.count()
        assert tree.conversations.sum() == df.select("conv_id").distinct().count()
    for _, shard in tree.groupby("shard"):
        shard = shard.sort_values("start")
        nodes = {bytes(n.key): n for n in shard.itertuples()}
        at = 0
        for n in shard.itertuples():
            assert n.start == at and n.n_tokens == len(n.token_ids) and decode(list(n.token_ids)) == n.formatted
            at += n.n_tokens
            ancestors, up = set(), bytes(n.parent)
            while up:
                ancestors |= set(range(nodes[up].start, nodes[up].start + nodes[up].n_tokens))
                assert nodes[up].start < n.start and n.subtree_end <= nodes[up].subtree_end
                up = bytes(nodes[up].parent)
            assert n.position == len(ancestors) and ancestors == {t for i in n.attends for t in range(i["start"], i["end"])}
            low, high = n.loss_tokens
            assert decode(list(n.token_ids)[low:high]) == n.formatted[n.loss_start:n.loss_end]


def test_chat_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = con.sql(op1.ORACLES["op1_chat_tree"]).df().sort_values("conv_id").reset_index(drop=True)
    got = op1.op1_chat_tree(spark, SMALL).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got[list(want.columns)].astype(want.dtypes.to_dict()).equals(want)


URLS = [None, "no scheme", "HTTP://WWW.Example.COM/en/x?y", "a://b://c/d#e", "x://freebetscasino.org", "x://example.com", "x://blog.example.com/en/", "x://net/es/",
        "x://-.--.net/fr/q", "x://", "x://ONLINEPOKER.org/a", "", "x://example.com/de/", "x://notexample.com/en/", "x://" + "a" * 90 + ".org/", "x://com?/en/", "é://É.com/é/"]


def test_url_parts_rules_and_verdicts(spark, folder):
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in op3.op3_url_filter(spark, folder(pages=df)).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for h, p, v in op3.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)
    assert got[4].words[:3] == ["free", "bets", "casino"] and got[4].verdict == "block"
    assert got[10].words[:2] == ["online", "poker"] or got[10].verdict == "block"
    assert {got[i].verdict for i in (0, 1, 9, 11)} == {"allow"}
    assert op3.op3_url_filter(spark, folder(pages=df.limit(0))).count() == 0


def test_segmentation_matches_all_splits():
    counts, total = {"free": 50, "bets": 20, "fre": 3, "ebets": 1, "e": 9, "b": 2, "bet": 30, "s": 40}, 1000
    for label in ("freebets", "xfreebets", "bbets", "q"):
        def cost(parts):
            return sum(log(counts[p] / total) if p in counts else log(10 / total) - len(p) * log(10) for p in parts)
        every = []
        for cuts in itertools.product([0, 1], repeat=len(label) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(label)]
            every.append([label[a:b] for a, b in zip(at, at[1:])])
        assert cost(op3.best_split(label, counts, total)) == pytest.approx(max(map(cost, every)))


def test_concatenated_words_of_the_pages_are_found(spark):
    text = "<p>" + "river bridge market stone " * 50 + "</p>"
    df = spark.createDataFrame([(1, "x://stonebridge.riverm.org/marketriver", text)], "page_id long, url string, html string")
    row = op3.judged(df).first()
    assert row.words[:4] == ["stone", "bridge", "river", "m"] and row.verdict == "allow"


def _sites(n, seed):
    """Urls of hosts that run two words of one kind together, each host labelled or not."""
    draw = random.Random(seed)
    kinds = {"block": "poker jackpot roulette slots".split(), "allow": "garden library museum kitchen".split()}
    out = []
    for i in range(n):
        kind = draw.choice(["block", "allow", "allow"])
        host = "".join(draw.sample(kinds[kind], 2)) + f"{draw.choice('abcdefgh')}.{'new' if i % 2 else 'known'}.org"
        out.append((i, kind, f"http://{host}/{'page' if i % 2 else 'bad' if kind == 'block' else 'good'}/{draw.choice(kinds[kind])}/{i}"))
    text = " ".join(w for ws in kinds.values() for w in ws * 50)
    return out, text


def _judged_sites(spark):
    rows, text = _sites(400, 1)
    df = spark.createDataFrame([(i, url, text) for i, _, url in rows], "page_id long, url string, html string")
    rules = [("known.org", "/bad/", "block"), ("known.org", "/good/", "allow")]
    return rows, {r.page_id: r for r in op3.judged(df, rules, seeds=[([], "allow")]).collect()}


def test_labels_come_from_the_rules_of_other_hosts(spark):
    rows, got = _judged_sites(spark)
    held_out = [(kind, got[i]) for i, kind, _ in rows if got[i].rule is None]
    assert len(held_out) == 200
    assert sum(kind == r.verdict for kind, r in held_out) / len(held_out) > 0.97


def test_classifier_matches_brute_force(spark):
    rows, got = _judged_sites(spark)
    counts, urls = {"block": Counter(), "allow": Counter()}, Counter()
    for r in got.values():
        if r.rule:
            counts[r.verdict].update(r.words)
            urls[r.verdict] += 1
    known = set(counts["block"]) | set(counts["allow"])
    size = {v: sum(c.values()) + op3.SMOOTH * len(known) for v, c in counts.items()}
    prior = log((urls["block"] + op3.PRIOR * op3.PRIOR_URLS) / (urls["allow"] + (1 - op3.PRIOR) * op3.PRIOR_URLS))
    for r in got.values():
        want = prior + sum(log((counts["block"][w] + op3.SMOOTH) / size["block"]) - log((counts["allow"][w] + op3.SMOOTH) / size["allow"])
                           for w in r.words if w in known)
        assert r.log_odds == pytest.approx(want, abs=1e-6)


def test_main_text_of_unseen_layouts():
    field = op9.trained()
    blocks = [op9.with_labels(*p) for p in op9.labelled_pages(200, seed=123)]
    pairs = [(a, b) for found, labels in blocks for a, b in zip(labels, field.decode(found))]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.985


def test_decoding_is_the_best_path():
    field = op9.trained()
    blocks = html_blocks.leaf_blocks("<article><h1>A title</h1><p>Some words of it.</p></article><div class='comments'><p>Nice.</p></div><footer>end</footer>")

    def value(labels):
        score = field.first[labels[0]] + sum(field.scores(b)[x] for b, x in zip(blocks, labels))
        return score + sum(field.move[a][b] for a, b in zip(labels, labels[1:]))
    assert value(field.decode(blocks)) == pytest.approx(max(map(value, itertools.product([0, 1], repeat=len(blocks)))))


def test_deep_pages_take_linear_time():
    field = op9.trained()

    def seconds(n):
        page = "<ul>" + "".join(f'<div class="a{i}">x y' for i in range(n)) + "<li>item.</li>" * n + "</section></div>" * n
        start = time.process_time()
        blocks = html_blocks.leaf_blocks(page)
        assert len(blocks) == 2 * n and len(field.decode(blocks)) == 2 * n
        return time.process_time() - start
    seconds(500)
    assert seconds(16_000) < 16 * seconds(2_000) + 0.5


def test_features_of_a_path_are_those_around_it():
    page = '<div class="a b"><section id="a"><div class="c"><p>One.<li>Two</div><p class="x">Three</section>Four</div>Five'
    found = [(b.text, set(op9.around(b.element)), b.element and b.element.part, b.element and b.element.inner) for b in html_blocks.leaf_blocks(page)]
    outer = {"in div", "name a", "name b"}
    assert found == [("One.", outer | {"in section", "name c", "in p"}, "section", ("c",)), ("Two", outer | {"in section", "name c", "in li"}, "section", ("c",)),
                     ("Three", outer | {"in section", "in p", "name x"}, "section", ("x",)), ("Four", outer, "", ("a", "b")), ("Five", set(), None, None)]
    field = op9.trained()
    for block in html_blocks.leaf_blocks(page):
        weights = [field.emit[f] for f in op9.features(block) if f in field.emit]
        assert field.scores(block) == pytest.approx((sum(a for a, _ in weights), sum(b for _, b in weights)))


def test_hidden_blocks_are_no_main_text(spark, folder):
    body = "<article><h1>A title</h1><p>The first part of the story goes here, with some words.</p>{}<p>And the second part ends it.</p></article>"
    hidden = ["<p hidden>Secret words that nobody sees here.</p>", '<div style="display: none">Secret words that nobody sees here.</div>',
              '<div aria-hidden="true"><p>Secret words that nobody sees here.</p></div>']
    df = spark.createDataFrame([(i, "u", body.format(h)) for i, h in enumerate(hidden)], "page_id long, url string, html string")
    texts = {r.text for r in op9.op9_main_text(spark, folder(pages=df)).collect()}
    assert texts == {"A title\n\nThe first part of the story goes here, with some words.\n\nAnd the second part ends it."}


def test_pages_of_the_table(spark):
    got = {r.page_id: r for r in op9.op9_main_text(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = page.html.split("<article>")[1].split("</article>")[0]
        parts = [html.unescape(x) for x in __import__("re").split(r"<(?:/?(?:h1|p)|br)>", inner)]
        want = "\n\n".join(" ".join(x.replace("<b>", "").replace("</b>", "").split()) for x in parts if x.replace("<b>", "").strip())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_broken_and_empty_pages(spark, folder):
    pages = [None, "", "plain words only", "<p>a &lt; b &amp c &am", "<article><p>one <p>two<div class=ad>buy</div><p>three", "<script>x</script", "<!-- open", "<a href='x>text",
             "<article><h1>T</h1><p>Some text.</p><table><tr><td>a<td>b</table></article>", "<" * 50, "<p>" + "word " * 50000, "<article><p>x\u00a0\u2003y<br>z</p></article>"]
    df = spark.createDataFrame([(i // 2, "u", p, "t", 5) for i, p in enumerate(pages)], "page_id long, url string, html string, text string, row int")
    got = op9.op9_main_text(spark, folder(pages=df))
    assert got.count() == len(pages) and got.where("n_chars <> length(text) OR text IS NULL").count() == 0
    whole = op9.main_texts(df)
    assert whole.columns == ["page_id", "url", "row", "text", "n_chars"]
    texts = [r.text for r in whole.collect()]
    assert "one\n\ntwo" in texts[4] and "buy" not in texts[4] and texts[11] == "x y z" and texts[0] == texts[1] == ""
    assert op9.op9_main_text(spark, folder(pages=df.limit(0))).count() == 0
