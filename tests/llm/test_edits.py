"""Fill-in-the-middle, page extraction and conversation repair: queries by brute force on whole small tables, and odd rows."""

import hashlib
import html
import itertools
import os
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone.llm import extract, fim, repair

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
CLASH = ["n", "form", "k", "code", "text2", "edit", "output", "bid", "audit", "c", "seen", "first"]


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


# --- op11


def brute_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 20
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text))


@given
def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = entry.queries()["op11_fill_in_middle"](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    assert sorted(map(tuple, got.collect())) == sorted(brute_fim(d.doc_id, d.text) for d in docs)


def test_fim_on_odd_rows(spark, tmp_path):
    rows = [(None, "no id at all"), (1, None), (2, ""), (3, "a<P>b"), (4, "<M>"), (5, "x" * 200_000), (6, "ab1 " * 60_000), (7, "日本語 😀\r\n\té́ <S <<S"), (7, "日本語 😀\r\n\té́ <S <<S"), (8, "<<PP>> S> <M"), (9, " \n ")]
    rows += [(i, f"word {i} <P is<S no>marker M>") for i in range(20, 120)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = entry.queries()["op11_fill_in_middle"](spark, f"{tmp_path}/odd").collect()
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(itertools.starmap(brute_fim, rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    whole = fim.fill_in_middle(df, plain=0, spm=50).collect()
    assert all(r.form != "plain" or r.doc_id in (1, 2, 3, 4) for r in whole)
    back = fim.fill_in_middle(df, plain=0, spm=50).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_fim_pieces_end_between_tokens():
    for text in ("ab.cd " * 50, "a" * 99, "é" * 99 + "abc" * 40 + "1", "", "zz9"):
        for piece in (1, 2, 7, 1000):
            assert fim.offsets(text, piece).tolist() == [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


# --- op12


def articles(page):
    """The article of a page of the given tables: its heading and paragraphs, of which some aren't closed."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
    return "\n".join(x for x in parts if x)


@given
def test_op12(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = entry.queries()["op12_html_extraction"](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == "page_id bigint, url string, text string, n_chars bigint"
    want = [(p.page_id, p.url, articles(p.html)) for p in pages]
    assert sorted(map(tuple, got.collect())) == sorted((i, u, t, len(t)) for i, u, t in want) and all(t for *_, t in want)


PARA = "It was the day that all of the people in the town had been waiting for, and when it came they were there in the square with their flags and with their children, to see what it was about and to hear what would be said by the one who came."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain words only", ""),
        (f"<p>{PARA}", PARA),
        (f"<p>{PARA}<p>Short.<p>{PARA}", f"{PARA}\nShort.\n{PARA}"),
        (f"<h1>Title</h1><p>{PARA}</p><p>The end.", f"Title\n{PARA}\nThe end."),
        (f"<div><a href=x>Home</a> <a href=y>News</a></div><p>{PARA}</p><ul><li><a href=z>{PARA}</a></li></ul>", PARA),
        (f"<article><h1>T&eacute;</h1><p>a&nbsp;&#8212; b<br>c &amp;amp; d</article><aside>{PARA}</aside>", "Té\na — b c &amp; d"),
        (f"<article><p>One.</p><div class='ad-box'>{PARA}</div><p>Two.</p><div class=advert>{PARA}</div></article>", "One.\nTwo."),
        (f"<article><header><h1>T</h1></header><p>{PARA}</p><footer>{PARA}</footer><nav>{PARA}</nav></article>", f"T\n{PARA}"),
        (f"<header>{PARA}</header><main><p>{PARA}</p></main><div>{PARA}</div>", PARA),
        (f"<body class='has-sidebar'><div id='cookie-notice'>{PARA}</div><p>{PARA}</p><section id=comments><article class=comment><p>{PARA}</p></article></section>", PARA),
        (f"<p>{PARA}</p><form><p>{PARA}</p><textarea>{PARA}</textarea></form><script>var a = '<p>{PARA}</p>'</script><style>p{{}}</style><!-- <p>{PARA}</p> -->", PARA),
        (f"<article><p>{PARA}</p><div hidden>{PARA}</div><p style='display: none'>{PARA}</p><div style='display:none'>{PARA}</div></article>", f"{PARA}\n{PARA}"),
        (f"<ARTICLE><P CLASS=x>{PARA}</ARTICLE><FOOTER>{PARA}", PARA),
        (f"<article><table><tr><td>a<td>b</table><pre>x\n  y</pre></article><p>{PARA}", "a\nb\nx y"),
        ("<article><p>x < y and a <b>b</b>c</article>", "x < y and a bc"),
        ("<article><script>never closed <p>text", ""),
    ],
)
def test_extraction_rules(page, want):
    assert extract.main_text(page) == want


def test_middling_and_short_blocks_inherit():
    low = "Widget harness gasket " * 8
    some = extract.inherit(extract.decide(extract.blocks(f"<p>Intro.</p><p>{PARA}</p><p>Short.</p><p>{low}</p><p>Tail.</p>")))
    assert [b.label for b in some] == [True, True, False, False, False]  # a short block between text and none is none
    inside = extract.inherit(extract.decide(extract.blocks(f"<article><p>{PARA}</p><p>Short.</p><p><a href=x>{low}</a></p></article>")))
    assert [b.label for b in inside] == [True, True, False]


def test_extraction_is_linear():
    for part in ('<a href="', "<p class='", "<!-- x ", "<div ", "<script>", "<b", "</", "&#x", "<textarea>", "<article><p>a", "<li class=ad>"):
        start = time.perf_counter()
        extract.main_text(part * 60_000)
        assert time.perf_counter() - start < 10, part


def test_extraction_on_odd_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{PARA}"), (3, "u", f"<p>{PARA}"), (3, "u", f"<p>{PARA}"), (4, "u", f"<p>{PARA}</p>" * 3000)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    df.write.parquet(f"{tmp_path}/odd/pages.parquet")
    got = {(r.page_id, r.url): r for r in entry.queries()["op12_html_extraction"](spark, f"{tmp_path}/odd").collect()}
    assert [got[x].n_chars for x in ((1, "u"), (2, None), (None, "u"), (3, "u"))] == [0, 0, len(PARA), len(PARA)] and got[4, "u"].n_chars == 3001 * len(PARA) - len(PARA) + 2999
    assert extract.extract(df).columns == [*df.columns, "text"] and extract.extract(df.limit(0)).count() == 0
    own = extract.extract(spark.createDataFrame([("<p>" + "blik zorp " * 30,)], "html string"), stop=["zorp"]).first().text
    assert own == ("blik zorp " * 30).strip()


# --- op13

TURNS = [{"u": "u", "s": "s"}, {"u": "u"}, {"a": "a"}, {"u": "u"}]  # by state: what may come


def brute_repair(rows):
    """rows (role, text) in order -> (blank, duplicate, truncated, illegal, cost, audit, repaired): all cheapest paths, forward."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    after = lambda q, x: None if x not in TURNS[q] else {"s": 1, "u": 2, "a": 3}[x]
    insert = lambda q: ("assistant", 3) if q == 2 else ("user", 2)

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit, out) in list(best.items()):
                role, to = insert(q)
                new = (cost + 2, audit + "I", [*out, f"{role}:"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserted({0: (0, "", [])})
    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for q, (cost, audit, out) in best.items():
            edits = [(3, "D", q, [])]
            if fault not in ("b", "d"):
                kept = after(q, role[:1])
                edits += [(fault == "t", "K", kept, [f"{role}:{text}"])] if kept else []
                name, to = insert(q)
                edits.append((2 + (fault == "t"), "R", to, [f"{name}:{text}"]))
            for more, letter, to, said in edits:
                x = (cost + more, audit + letter, out + said)
                if to not in new or x[:2] < new[to][:2]:
                    new[to] = x
        best = inserted(new)
    cost, audit, out = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, "\n".join(out)


def brute_query(rows):
    """rows (conv_id, turn, role, text), as given -> the contract's rows."""
    out, ids = [], {r[0] for r in rows}
    blank = lambda x: " " if x is None else x
    for conv in ids:
        held = []
        for i, turn, role, text in rows:
            if i == conv:
                fault = zlib.crc32(f"{blank(i)}:{blank(turn)}".encode()) % 20
                role, text = blank(role), blank(text)
                role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                held += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(f"{blank(conv)}:{len(r[1])}:{r[1]}{r[2]}")))
        turns = [t for t, *_ in held if t is not None]
        b, d, t, illegal, cost, audit, text = brute_repair([r[1:] for r in held])
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, b, d, t, illegal, cost, audit, sha(text)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def asked(spark, folder):
    got = entry.queries()["op13_conversation_repair"](spark, folder)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@given
def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert asked(spark, SF) == brute_query(rows)


def test_op13_on_odd_rows(spark, tmp_path):
    pick = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "", " \t ", None, "Well! ", "a\nb?", "x" * 50]
    rows = [(pick.choice([None, *range(60)]), pick.choice([None, *range(9)]), pick.choice(roles[: pick.choice((2, 7))]), pick.choice(texts)) for _ in range(700)]
    rows += [(100, i, "user" if i % 3 else "assistant", pick.choice(texts[:3])) for i in range(900)]  # a third or more of all rows
    rows += [(101, 5, "user", "again.")] * 300 + [(102, -(1 << 40), "user", "x."), (102, 1 << 40, "assistant", "y.")]
    schema = "conv_id long, turn long, role string, text string"
    clashing(spark.createDataFrame(rows, schema)).write.parquet(f"{tmp_path}/odd/conversations.parquet")
    assert asked(spark, f"{tmp_path}/odd") == brute_query(rows)
    clashing(spark.createDataFrame([], schema)).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert asked(spark, f"{tmp_path}/none") == []


def test_long_conversations_are_solved_in_blocks(spark):
    pick = random.Random(3)
    rows = [(c, i, pick.choice(["user", "assistant", "system", "tool"]), pick.choice(["Yes.", "No", "", f"t{i}."])) for c in range(4) for i in range(150)]
    df = repair.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    for size in (1, 3, 64):
        parts = repair.audits(df, size)
        assert parts.count() >= 4 * 150 / size
        said = {r.conv_id: r for r in repair.summary(parts).collect()}
        turns = {}
        for r in repair.repaired(df, parts).collect():
            turns.setdefault(r.conv_id, []).append(r)
        for c in range(4):
            b, d, t, illegal, cost, audit, text = brute_repair([r[2:] for r in rows if r[0] == c])
            assert (said[c].blank, said[c].duplicate, said[c].truncated, said[c].illegal, said[c].cost, said[c].audit) == (b, d, t, illegal, cost, audit)
            own = sorted(turns[c], key=lambda r: r.place)
            assert "\n".join(f"{r.role}:{r.text}" for r in own) == text and "".join(r.edit for r in own) == audit.replace("D", "")


def test_bucket_queue_gives_least_costs():
    pick = random.Random(5)
    for _ in range(300):
        codes = bytes(pick.randrange(16) for _ in range(pick.randrange(9)))
        rows = [(["user", "assistant", "system", "tool"][c & 3], c >> 2) for c in codes]
        goal = [pick.choice([0, 1, 4, 9, repair.FAR]) for _ in range(4)]
        if min(goal) == repair.FAR:
            continue
        now = list(goal)  # by plain recursion from the end
        for back in range(len(rows), -1, -1):
            if back < len(rows):
                role, fault = rows[back]
                more, step = int(fault == repair.TRUNCATED), []
                for q in range(4):
                    found = [3 + now[q]]
                    if fault in (repair.NONE, repair.TRUNCATED):
                        found.append(2 + more + now[repair.TURN[q]])
                        to = TURNS[q].get(role[0])
                        found += [more + now[{"s": 1, "u": 2, "a": 3}[to]]] if to else []
                    step.append(min(found))
                now = step
            for _ in range(3):
                now = [min(now[q], 2 + now[repair.TURN[q]]) for q in range(4)]
        assert [min(x, repair.FAR) for x in now] == repair.distances(codes, goal)[:4]
