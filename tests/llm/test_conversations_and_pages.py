"""Operators 11 to 13 against plain versions of their contracts, on the small tables and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from freightgraph.llm.conversation_repair import SYMBOLS, Evaluator, damaged, pair_grammar, repair_conversations
from freightgraph.llm.html_extract import blocks_of, extract, extract_text, parse
from freightgraph.llm.prefix_trie import conversation_trie
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def talks(spark):
    return spark.read.parquet(f"{DATA}/conversations.parquet")


@pytest.fixture(scope="module")
def odd_talks(spark):
    """Nulls in every column, one long conversation, repeated rows, ties, strange roles, a long text, and clashing names."""
    rng = random.Random(7)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["a.", "b", " ", f"t{i}.", f"t{i}"])) for i in range(400)]
    rows += [(2, None, "user", "x."), (2, None, "assistant", None), (2, 3, None, "y."), (2, 3, "user", "y."), (2, 3, "user", "y."), (None, 1, "user", "q."), (None, None, "assistant", "r.")]
    rows += [(3, 0, "", ""), (4, 0, "tool", "long. " * 40_000), (4, 1, "user", "é🙂 fin."), (5, -5, "system", "only."), (100, 0, "user", "p."), (100, 1, "assistant", "q."), (101, 0, "user", "p."), (150, 7, "user", "p.")]
    rows += [(c, 0, "user", "same.") for c in range(200, 330)] + [(c, 1, "assistant", "same.") for c in range(200, 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("key", "part", "idx", "seq", "base", "h", "gone_", "late", "at", "symbols", "place", "shard"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


# 11 — repair

def plain_damage(rows):
    """conv → rows (turn, role, text) after damage, in the operator's order; every conversation is there."""
    out = defaultdict(list)
    sp = lambda v: " " if v is None else str(v)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        out[c]
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """All of the result by a forward search over (cost, audit) for each state of the role grammar."""
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, faults = set(), []
    for _, role, text in turns:
        body = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    ok = lambda s: s in ("", "a")

    def insert(states):
        todo = list(states.items())
        while todo:
            s, (cost, audit, lines) = todo.pop()
            r = "a" if s == "u" else "u"
            new = (cost + 3, audit + "I", [*lines, ("user" if r == "u" else "assistant") + ":"])
            if r not in states or new[:2] < states[r][:2]:
                states[r] = new
                todo.append((r, new))
        return states

    states = {"": (0, "", [])}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        ahead = {}

        def put(s, entry, ahead=ahead):
            if s not in ahead or entry[:2] < ahead[s][:2]:
                ahead[s] = entry

        for s, (cost, audit, lines) in insert(states).items():
            put(s, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role and (role[0], s) in step:
                put(role[0], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            r = "a" if s == "u" else "u"
            put(r, (cost + 3 + more, audit + "R", [*lines, ("user:" if r == "u" else "assistant:") + text]))
        states = ahead
    cost, audit, lines = min((v for s, v in insert(states).items() if ok(s)), key=lambda v: v[:2])
    legal = {"su", "ua", "au"}
    roles = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in legal for a, b in itertools.pairwise(roles))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repairs_equal_plain_search(talks):
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(sorted(t, key=lambda x: x[0])) for c, t in plain_damage(rows).items()}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair_conversations(damaged(talks)).collect()}
    assert got == want and any("I" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values())


def test_odd_conversations(spark, odd_talks):
    import xxhash

    rows = [tuple(r) for r in odd_talks.select("conv_id", "turn", "role", "text").collect()]
    ties = {(r["role"], r["text"]): r["tie"] for r in damaged(odd_talks).select("role", "text", F.xxhash64("role", "text").alias("tie")).collect()}
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), ties[x[1], x[2]])
    want = {c: plain_repair(sorted(t, key=order)) for c, t in plain_damage(rows).items()}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair_conversations(damaged(odd_talks)).collect()}
    assert got == want and want[1][2] > 64
    assert repair_conversations(odd_talks.where("false")).count() == 0 and xxhash


def test_grammar_changes_no_result(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choices(SYMBOLS[:10], k=rng.randint(0, 60))) for _ in range(200)]
    rules = pair_grammar(spark.createDataFrame([(s, 1) for s in strings], "seq string, n int"))
    assert len(rules) > 4
    by_rules, plain = Evaluator(rules), Evaluator([])
    for s in strings:
        assert by_rules.audit([s]) == plain.audit([s])
        assert by_rules.audit([s[:7], s[7:]])[0] == plain.audit([s])[0] and "".join(by_rules.audit([s[:7], s[7:]])[1]) == plain.audit([s])[1][0]


# 13 — prefix trie

def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    seqs = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in seqs}
    built = {c: seqs.get(c - c % 100, [])[: h[c]] + s[h[c] :] for c, s in seqs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    sha = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items()), key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shard", [512, 3])
def test_trie_equals_plain_trie(talks, odd_talks, shard):
    for df in (talks, odd_talks):
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        got = sorted((tuple(r[c] for c in NODE) for r in conversation_trie(df, shard).collect()), key=str)
        assert got == plain_trie(rows)
    assert conversation_trie(odd_talks.where("false"), shard).count() == 0


# 12 — main text

def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_parser_is_forgiving():
    text = lambda h: blocks_of([parse(h)])
    assert text("<p>a<p>b &amp c<br>d</P><ul><li>x<li>y<ul><li>z</ul></ul><td>q") == ["a", "b & c d", "x", "y", "z", "q"]
    assert text("<p><b>bold<br><p>next</b> more") == ["bold", "next more"]
    assert text("1 < 2 <!-- <p>no</p> --> 3<p title='a>b'>q&#233;&nbsp;r</p") == ["1 < 2 3", "qé r"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a b", "c"] and text("") == [] and text("<div><span>x</span>y</div>z") == ["xy", "z"]
    assert len(blocks_of([parse("<div>" * 30_000 + "deep")])) == 1


def test_structure_is_left_out():
    body = """<header><h2>Site</h2></header><nav><a>n</a></nav><div class="cookie-notice">c</div><div class="ad">x</div>
    <article><header><h1>Title</h1></header><p>One &amp; two.</p><div class="share-buttons">s</div><form><p>f</p></form><aside>a</aside><ul><li>item</li></ul><style>z</style>
    <section id="comments"><article class="comment"><p>first!</p></article></section></article><div class="sidebar"><article><p>teaser</p></article></div><footer>f</footer>"""
    assert extract(page(body), set()) == "Title\n\nOne & two.\n\nitem"
    soup = """<div class="topMenu"><a>m</a></div><div id="wrap"><h1>Title</h1><div class="x1">Some <i>text</i>\n here.</div><ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul></div><div>© 2020 Site</div>"""
    assert extract(page(soup), set()) == "Title\n\nSome text here."
    assert extract(page("<div class='page with-sidebar'><div>only text</div></div>"), set()) == "only text"


def test_site_templates(spark):
    rows = [(i, f"http://A.example/{i}", page(f"<div class='z1'>Welcome to the <b>site</b></div><div><p>Story {i} begins.</p><p>{'Shared line.' if i < 3 else f'Own line {i}.'}</p></div><div>Number {i % 2} of two</div>")) for i in range(12)]
    rows += [(100 + i, "http://b.example/", page("<div>Welcome to the <b>site</b></div><p>copied page</p>")) for i in range(9)] + [(200, "http://c.example/", page("<div>Welcome to the <b>site</b></div>")), (201, None, None), (202, "x", ""), (None, None, "<p>no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("host", F.lit("h")).withColumn("templates", F.lit("t"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        want = f"Story {i} begins.\n\n" + ("Shared line." if i < 3 else f"Own line {i}.")
        assert got[i] == (want, len(want))
    assert got[100][0] == "Welcome to the site\n\ncopied page" and got[200][0] == "Welcome to the site"
    assert got[201] == ("", 0) == got[202] and got[None] == ("no id", 5)
    assert extract_text(df.where("false")).count() == 0


def test_article_text_is_whole(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    import html

    squash = lambda s: " ".join(s.split())
    for r in pages.collect():
        inner = re.search("<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        assert squash(html.unescape(re.sub("<[^>]*>", " ", inner))) == squash(got[r["page_id"]])
