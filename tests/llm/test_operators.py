"""The ten operators against brute force, exact round trips or held-out accuracy, and their odd cases."""

import hashlib
import io
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import bpe, common, components, exact_dedup, html_text, language, packing, quality, simhash, token_files, warc, weighted_minhash
from tidewheel.llm import queries as registered

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PATTERN = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEN = [n for n in registered.QUERIES if n.startswith("op")]


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in TEN) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registered.QUERIES[name](spark, SF)
    found = c.execute(registered.ORACLES[name])
    names = [d[0] for d in found.description]
    assert Counter(map(repr, map(tuple, found.fetchall()))) == Counter(repr(tuple(r)) for r in got.select(*names).collect())


# ---------------------------------------------------------------- 1


def expected_ids(docs):
    model = Tokenizer.from_file(WORDS)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    return [(i, model.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]


def test_token_files(spark, messy, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_files.write_token_files(messy, out, token_files.encoder_of(WORDS, 1), shard_bytes=20_000)
    got = sorted(collected(token_files.read_token_files(spark, out)), key=lambda r: r["start"])
    at = 0
    want = expected_ids(messy)
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter((i, np.array(ids, "<u4").tobytes()) for i, ids in want)
    for r in got:
        assert (r["start"], 4 * r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(r["ids"]))
        at += r["n_tokens"]
    assert spark.read.parquet(f"{out}/manifest").count() > 1


def test_one_document_is_read_alone(tmp_path):
    path = tmp_path / "s"
    writer = token_files.ShardWriter(open(path, "wb"), 2)
    docs = {k: np.arange(k * 10, dtype="<u2") for k in range(50)}
    for k, ids in docs.items():
        writer.add(k, ids.tobytes())
    writer.close()
    data = path.read_bytes()
    assert len(data) == writer.size
    reads = []

    class Watched(io.BytesIO):
        def read(self, n=-1):
            reads.append((self.tell(), n))
            return super().read(n)

    shard = token_files.ShardReader(Watched(data), len(data))
    reads.clear()
    assert shard.find(37).tolist() == docs[37].tolist()
    assert len(reads) == 1
    assert reads[0][1] < 600
    with pytest.raises(KeyError):
        shard.find(99)
    broken = bytearray(data)
    broken[int(shard.at[37]) + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's checksum or the table's
        token_files.ShardReader(io.BytesIO(bytes(broken)), len(data)).find(37)
    with pytest.raises(ValueError, match="seek table"):
        token_files.ShardReader(io.BytesIO(b"x" * 40), 40)


def test_long_documents_take_several_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    writer = token_files.ShardWriter(open(tmp_path / "s", "wb"), 4)
    ids = np.arange(1234, dtype="<u4")
    writer.add(5, ids.tobytes())
    writer.add(None, b"")
    writer.close()
    data = (tmp_path / "s").read_bytes()
    shard = token_files.ShardReader(io.BytesIO(data), len(data))
    assert shard.find(5).tolist() == ids.tolist()
    assert (int(shard.frames[0]), len(shard.ids(1))) == (13, 0)


def test_chunks_give_the_ids_of_whole_texts():
    model, random_ = token_files.ChunkEncoder(WORDS, 1), random.Random(3)
    lib = Tokenizer.from_file(WORDS)
    lib.encode_special_tokens = True
    letters = "abcABC éÉßÀ'sS .,!\n\t\r\x01\x85\xa0 ́ΣσİK日12½_-<|endoftext|>"
    texts = ["".join(random_.choice(letters) for _ in range(random_.randint(0, 40))) for _ in range(1500)]
    for got, t in zip(model.encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_strings_of_added_tokens_are_their_ids():
    model = token_files.ChunkEncoder(WORDS, 1)
    got = model.encode(["a <|endoftext|> c", "<|startoftext|>", "x<|endoftext|><|endoftext|>y"])
    assert 49407 in np.frombuffer(got[0], "<u2")
    assert np.frombuffer(got[1], "<u2").tolist() == [49406, 1]
    assert np.frombuffer(got[2], "<u2").tolist()[1:3] == [49407, 49407]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(token_files.ChunkEncoder, "CHARS", 50)
    model, lib, random_ = token_files.ChunkEncoder(WORDS, 1), Tokenizer.from_file(WORDS), random.Random(6)
    texts = ["".join(random_.choice("abc é' 日\n.") * random_.choice((1, 1, 1, 70)) for _ in range(random_.randint(0, 300))) for _ in range(60)]
    for got, t in zip(model.encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids + [1]


def test_kept_units_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files.ChunkEncoder, "SLOTS", 64)
    model = token_files.ChunkEncoder(WORDS, 1)
    first = model.encode([f"word{k} thing" for k in range(20)])
    model.encode([f"other{'x' * k}" for k in range(20)])
    model.encode(["one more"])
    assert model.n <= 4
    assert model.encode([f"word{k} thing" for k in range(20)]) == first


# ---------------------------------------------------------------- 2


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0d]", "", t or "")


def test_exact_dedup(messy):
    got = collected(exact_dedup.exact_duplicates(messy))
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i))
    best = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == best[r["text_sha256"]]
    assert sum(r["kept"] for r in got) == len(best)
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    assert Counter(squeezed(r["text"]) for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))


# ---------------------------------------------------------------- 3


def test_byte_bpe_equals_tiktoken(spark, messy):
    model = bpe.BytePairs(BYTES, PATTERN)
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    letters, random_ = "abcdehtTHE  \n\t'\x1c\x1f\x85\xa0 éßΣ日😀12٣,.!s're\x00", random.Random(4)
    texts = ["".join(random_.choice(letters) for _ in range(random_.randint(0, 50))) for _ in range(800)]
    texts += ["", None, "a" * 3000, "thethe" * 400, "\n" * 2000, "<|endoftext|>", "".join(random_.choice("abcdeth") for _ in range(2440)), "".join(random_.choice("abcdeth") for _ in range(5000))]
    got = model.encode(texts)
    assert [g.tolist() for g in got] == [lib.encode_ordinary(t or "") for t in texts]
    assert model.decode(got) == [(t or "").encode() for t in texts]
    with pytest.raises(ValueError, match="not in the vocabulary"):
        model.decode([np.array([60_000])])
    words = ["".join(random_.choice("abcdeht ") for _ in range(random_.randint(2, 40))).encode() for _ in range(300)]
    assert model.contract(words) == [model.contract_long(w) for w in words]
    rows = {r["doc_id"]: r for r in bpe.round_trip(messy.filter("doc_id > 9"), BYTES, PATTERN).collect()}
    for r in messy.filter("doc_id > 9").select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r["text"] or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert tuple(rows[r["doc_id"]])[1:] == want
    both = bpe.decode(bpe.encode(messy, BYTES, PATTERN), BYTES, PATTERN)
    assert Counter((r[0], bytes(r[1])) for r in both.collect()) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in messy.select("doc_id", "text").collect())


def test_matches_are_found_as_the_pattern_has_them(monkeypatch):
    """White space, apostrophes and characters beyond Latin-1 in every order; parts, forgetting, another pattern."""
    model, random_ = bpe.BytePairs(BYTES, PATTERN), random.Random(14)
    assert bpe.SPLIT == PATTERN
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    bits = [*"abcdeT  \n\t'\x1c\x1f\x85\xa0\r\x0b\x00 éßΣ日😀12٣²½,.!", "\u3000", "\u2028", " \u2003", "\u200b", " don't", "\n\n", "'ll", "''s", " 's", "a b "]
    for turn in range(6):
        monkeypatch.setattr(model.units, "CHARS", (1 << 20, 30)[turn % 2])
        monkeypatch.setattr(bpe, "POOL", (1 << 22, 100)[turn // 2 % 2])
        texts = ["".join(random_.choices(bits, k=random_.randint(0, 60))) for _ in range(400)] + ["", None]
        assert [g.tolist() for g in model.encode(texts)] == [lib.encode_ordinary(t or "") for t in texts]
    pattern = r"\S+|\s+"
    other, lib = bpe.BytePairs(BYTES, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=model.ranks, special_tokens={})
    texts = ["one  two\nthree's", "", "日 b"]
    assert [g.tolist() for g in other.encode(texts)] == [lib.encode_ordinary(t) for t in texts]
    assert model.encode([]) == []


# ---------------------------------------------------------------- 4


def test_html_text(spark):
    nav = "<nav><ul><li><a href='/a'>Menu entry</a></li></ul></nav>"
    main = "<h1>Title &amp; more</h1><p>First   paragraph with\n<b>bold</b> words &eacute;&#233;.<p>Second one<br>broken.</p>"
    other = "<footer>Footer text</footer><aside>Side</aside><div class='ad-2 box'>Buy this</div><div id=comments><p>A reader says a lot of words here, many more words than the text has.</p></div><form><p>Name</p></form><div class='cookie-notice'>We use cookies</div><script>var t='<p>x</p>';</script><style>p{}</style><noscript>no</noscript><header>Head</header>"
    want = "Title & more\nFirst paragraph with bold words éé.\nSecond one broken."
    page = lambda body: f"<!DOCTYPE html><html><head><title>T</title></head><body>{nav}{body}{other}</body></html>"
    cases = [
        (1, "http://a.example/x", page(f"<article>{main}</article>"), want),
        (2, "http://a.example/y", page(f"<div class='post-17 body'>{main}</div>"), want),
        (3, "http://a.example/z", page(f"<!-- c --><article>{main}"), want),
        (4, "http://b.example/", None, ""),
        (5, None, "", ""),
        (6, "not a url", "just text &lt;here", "just text <here"),
        (7, "http://c.example/", "<p>one<p>two", "one\ntwo"),
        (8, "http://c.example/", "<div><div></div></div>", ""),
        (9, "http://d.example/", "<article><p>" + "word " * 20_000 + "</article>", ("word " * 20_000).strip()),
        (1, "http://a.example/x", page(f"<article>{main}</article>"), want),
        (None, "http://a.example/w", page("<article><h1>Only a title</h1></article>"), "Only a title"),
        (12, "http://f.example/", "<div class='post ad-free'><p>Kept whole.</p></div>", "Kept whole."),
        (13, "http://f.example/", "<div class='main-content no-sidebar'><h1>T</h1><p>Also kept.</p></div><div class=sidebar><p>Gone, and much longer than the text beside it is.</p></div>", "T\nAlso kept."),
        (14, "http://g.example/", "<article><p>Before.</p><div class='related-work'><p>Still the article.</p></div><p>After.</p></article>", "Before.\nStill the article.\nAfter."),
        (15, "http://g.example/", "<form id=all><div class=banner><h1>Title</h1><p>A page inside a form.</p><button>Go</button></div></form>", "Title\nA page inside a form."),
        (16, "http://i.example/", "<p>a&am<b>p;</b> &lt;tag&gt; &#x41;&notin; 1 < 2 & 3<4</p>", "a&amp; <tag> A∉ 1 < 2 & 3<4"),
        (17, "http://i.example/", "<table><tr><td class=ad>no<td>yes<tr><td>more</table>", "yes\nmore"),
        (18, "http://j.example/", "<div id=header><p>Our site, for every day of the year and more</p></div><div class=c><p>The text of the page, which says what it has to say.</p></div>", "The text of the page, which says what it has to say."),
        (19, "http://k.example/", "<div class='page-header'><h1>Title of it</h1></div><article><div class=header><p>By someone</p></div><p>The text.</p></article>", "By someone\nThe text."),
        (11, "http://e.example/", "<body><p class=x hidden>gone</p><p>kept &nbsp; text</p><ul><li>item one<li>item two</ul></body>", "kept text\nitem one\nitem two"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, html string").withColumn("path", F.lit("x"))
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == Counter((c[0], c[1], c[3], len(c[3])) for c in cases)
    assert html_text.extract(df.limit(0)).count() == 0


def test_host_consensus_decides_a_page(spark):
    """A page whose own best container is another one follows its host."""
    usual = "<div class=main><p>{}</p><p>{}</p></div><div class=extra><p>short</p></div>"
    odd = "<div class=main><p>Short news.</p></div><div class=extra><p>" + "Far longer text that stands beside it. " * 20 + "</p></div>"
    rows = [(k, "http://h.example/p", usual.format("Some long paragraph of the page. " * 9, "And one more of them. " * 9)) for k in range(8)]
    df = spark.createDataFrame([*rows, (99, "http://h.example/odd", odd)], "page_id long, url string, html string")
    page = html_text.Page(odd)
    assert page.path(page.best()[0]) == "div.extra"
    usual_page = html_text.Page(rows[0][2])
    won = html_text.host_paths(df).collect()
    assert [(r["host"], r["n"]) for r in won] == [("h.example", 9)]
    assert usual_page.path(usual_page.paths.index(won[0]["path"])) == "div.main"
    assert html_text.extract(df).filter("page_id = 99").first()["text"] == "Short news."


def test_light_hosts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = [(k, f"http://h{k}.example/", f"<article><p>text {k}</p></article>") for k in range(5)] + [(k, "http://big.example/", f"<div class=m><p>own {k}</p></div>") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.extract(df).collect()) == sorted([f"text {k}" for k in range(5)] + [f"own {k}" for k in range(10, 40)])


class Tree(HTMLParser):
    """A page as nested lists [tag, attributes, children], by the rules in words: the slow form."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.up, self.raw = [self.root], None
        self.feed(source)
        self.close()

    def _within(self, tags, limit):
        """The outermost of ``tags`` open inside the nearest of ``limit``; ends it."""
        k, found = len(self.up) - 1, None
        while k > 0 and self.up[k][0] not in limit:
            found = k if self.up[k][0] in tags else found
            k -= 1
        if found:
            del self.up[found:]
        return bool(found)

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag in html_text.RAW:
            self.raw = tag
            return
        level = html_text.CELLS
        ended = False
        if tag in level:
            ended = self._within({t for t in level if level[t] >= level[tag]}, {"table"})
        elif tag in html_text.ITEMS:
            ended = self._within(html_text.ITEMS[tag], html_text.SCOPES)
        if not ended and tag in html_text.ENDS_P:
            self._within({"p"}, html_text.SCOPES)
        node = [tag, {k: v or "" for k, v in reversed(attrs)}, []]
        self.up[-1][2].append(node)
        if tag not in html_text.VOID:
            self.up.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in html_text.VOID and tag not in html_text.BLOCKS and not self.raw:
            self.up.pop()

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
            return
        if any(n[0] == tag for n in self.up[1:]):
            while self.up.pop()[0] != tag:
                pass
        elif tag in ("p", "br"):
            self.up[-1][2].append(["/p", {}, []])

    def handle_data(self, data):
        if not self.raw:
            self.up[-1][2].append(data)


def plain_page(source):
    """[(text, path, parent's path, score, ancestors' paths)] of the blocks that count."""
    tree, blocks, run = Tree(source or "").root, [], []
    seen = {"began": None}

    def flush(boxes, para, soft):
        text = "".join(t for t, _ in run)
        if text.split():
            blocks.append([" ".join(text.split()), min(sum(len(t) for t, a in run if a), len(" ".join(text.split()))), boxes, para, soft])
        run.clear()

    def walk(node, boxes, para, softs, out, link, within):
        for child in node[2]:
            if isinstance(child, str):
                if not out:
                    run.append((child, link))
                continue
            tag, attrs, _ = child
            if tag == "/p":
                flush(boxes, para, softs)
                continue
            block = tag in html_text.BLOCKS
            if block:
                flush(boxes, para, softs)
            if tag == "br" and not out:
                run.append((" ", False))
            if tag in html_text.VOID:
                continue
            skip = out or tag in html_text.OUT_TAGS or (tag == "header" and not (within and seen["began"] == len(blocks)))
            if tag in ("article", "main", "h1") and not out:
                for s in softs:
                    s["holds"] = True
                seen["title"] = seen.get("title") or not softs
            inner = softs
            if not skip:
                skip = "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "").lower()) is not None
                say, about = (True, False) if tag == "form" else (False, False)
                if not say and tag not in html_text.WHOLE_PAGE:
                    say, about = html_text.told(" ".join(attrs.get(k, "") for k in ("class", "id", "role")), within)
                skip = skip or (say and not block)
                if say and not skip:
                    inner = (*softs, {"comments": about, "holds": False})
            place = boxes
            if tag in html_text.CONTAINERS and not skip:
                place = (*boxes, (len(seen), ".".join([tag, *sorted(re.sub(r"\d+", "#", attrs.get("class", "").lower()).split())])))
                seen[len(seen)] = None
            if tag in ("article", "main"):
                seen["began"] = len(blocks)
            walk(child, place, tag in html_text.PARAGRAPHS or (para and tag not in html_text.CONTAINERS) if block else para, inner, skip, link or tag == "a", within or tag in ("article", "main"))
            if block:
                flush(place, tag in html_text.PARAGRAPHS or (para and tag not in html_text.CONTAINERS), inner)

    walk(tree, (), False, (), False, False, False)
    flush((), False, ())
    prose = lambda some: sum((len(b[0]) - b[1]) * b[3] for b in some)
    kept = []
    for b in blocks:
        for soft in b[4]:
            own = [x for x in blocks if any(soft is y for y in x[4])]
            whole = sum(len(x[0]) for x in own) == sum(len(x[0]) for x in blocks)
            if not (whole if soft["comments"] else soft["holds"] or (not seen.get("title") and prose(own) > html_text.MOST * prose(blocks))):
                break
        else:
            kept.append(b)
    return kept


def plain_best(blocks):
    score = {}
    for text, linked, boxes, para, _ in blocks:
        worth = (len(text) - 2 * linked) * (1 if para else 0.5)
        for part, box in zip((1, 0.5), (boxes, boxes[:-1]), strict=True):
            if box:
                score[box] = score.get(box, 0) + worth * part
    good = {k: v for k, v in score.items() if v > 0}
    top = max(good, key=lambda k: (good[k], -k[-1][0]), default=())
    return tuple(step for _, step in top), (good[top] / sum(good.values()) if top else 0)


def plain_texts(rows):
    """(page_id, url) to text, page after page."""
    pages = [(i, u, plain_page(h)) for i, u, h in rows]
    host = lambda u: m[1].lower() if (m := re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "")) else ""
    votes = defaultdict(Counter)
    for _, u, blocks in pages:
        path, share = plain_best(blocks)
        if path:
            votes[host(u)][path] += round(share * 1000)
    out = []
    for i, u, blocks in pages:
        won = [max(votes[host(u)].items(), key=lambda x: x[1])[0]] if votes[host(u)] else []
        for path in [*won, plain_best(blocks)[0], ()]:
            found = [b[0] for b in blocks if any(tuple(s for _, s in b[2][:k]) == path for k in range(len(b[2]) + 1))]
            if found:
                break
        out.append((i, u, "\n".join(found) if blocks else ""))
    return Counter(out)


def test_pages_against_the_slow_form(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html_text.op4_html_text(spark, SF).collect())
    assert got == plain_texts(rows)
    random_ = random.Random(21)
    tags = ["div", "p", "b", "a", "li", "ul", "td", "tr", "table", "article", "header", "nav", "h1", "form", "span", "section"]
    names = ["", "", "", " class=ad", " class='main x9'", " class=sidebar", " id=comments", " class='no-ads'", " hidden", " class=related-work", " style='display: none'", " role=banner", " data-x='>'", " id=header", " class='site-header top'"]

    def made():
        out = []
        for _ in range(random_.randint(0, 60)):
            kind = random_.random()
            out.append(f"<{random_.choice(tags)}{random_.choice(names)}>" if kind < 0.4 else f"</{random_.choice(tags)}>" if kind < 0.65 else random_.choice(["<br>", "<!-- c <p> -->", "<script>x<p></script>", " &amp; ", "&lt;p&gt;"]) if kind < 0.75 else " ".join(random_.choice(["some", "words", "of", "text", "here."]) for _ in range(random_.randint(1, 12))))
        return "".join(out)

    odd = [(k, f"http://{'abc'[k % 3]}.example/{k}" if k % 5 else None, made()) for k in range(250)]
    votes_tie = plain_texts(odd)
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html_text.extract(spark.createDataFrame(odd, "page_id long, url string, html string")).collect())
    assert got == votes_tie


def test_hostile_pages_take_linear_time():
    n = 300_000
    for source in ("<a " * (n // 3), '<div class="c">' * (n // 15), "</b>" * (n // 4), '<a x="' * (n // 6), "<" * n, "<!--" * (n // 4), "<!" * (n // 2), "<b>" * 30_000 + "<p>x" * 30_000, "<a " + "x" * n + ">", "<title>" * (n // 7), "<li>" * (n // 4), "<a b='" + '=" ' * (n // 3) + ">", "<p>" * 1000 + "</p></i>" * 30_000, "<table>" * 10_000 + "<td>" * 10_000):
        began = time.process_time()
        html_text.Page(source).text(None)
        assert time.process_time() - began < 2, source[:20]


# ---------------------------------------------------------------- 5


def plain_pack(sizes, lengths, overhead, choose):
    """Best fit in its plainest form: (bin length, positions); ``choose``: (sizes left, this size) to the length opened."""
    rooms, held = [], []
    for k, size in enumerate(sizes):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= size]
        b = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(choose(sizes[k:], size))
            held.append([])
        rooms[b] -= size
        held[b].append(k)
    return [(min(c for c in lengths if c >= sum(sizes[k] for k in b)), b) for b in held]


def plain_choice(lengths, overhead):
    def rate(length, left, size):
        used, rest = size, sorted(left[1:], reverse=True)
        for one in rest:
            if used + one <= length:
                used += one
        return (min(c for c in lengths if c >= used) + overhead) / used

    return lambda left, size: min((n for n in lengths if n >= size), key=lambda n: (rate(n, left, size), -n))


def test_packing_opens_bins_at_least_cost():
    random_, lengths = random.Random(8), (8, 16, 32, 64)
    cost = lambda bins, overhead: sum(n + overhead for n, _ in bins)
    ratios = []
    for turn in range(60):
        overhead = (0, 2, 5)[turn % 3]
        sizes = sorted((random_.randint(1, 64) if random_.random() < 0.4 else random_.randint(1, 20) for _ in range(random_.randint(1, 9))), reverse=True)
        bins = packing.pack(sizes, lengths, overhead)
        assert sorted(k for _, b in bins for k in b) == list(range(len(sizes)))
        uniform = [plain_pack(sizes, lengths, overhead, lambda left, s, n=n: max(n, min(c for c in lengths if c >= s))) for n in lengths]
        chosen = plain_pack(sizes, lengths, overhead, plain_choice(lengths, overhead))
        assert cost(bins, overhead) == min(cost(b, overhead) for b in [chosen, *uniform])
        ratios.append(cost(bins, overhead) / packing.least_cost(sizes, lengths, overhead))
    assert min(ratios) == 1
    assert sum(ratios) / len(ratios) < 1.02
    assert max(ratios) < 1.2
    assert packing.pack([]) == []
    assert packing.pack([512, 512]) == [(1024, [0, 1])]
    assert packing.pack([5]) == [(512, [0])]


def test_least_cost_by_hand():
    assert packing.least_cost([], (8, 16), 1) == 0
    assert packing.least_cost([5, 5, 5], (8, 16), 1) == 17
    assert packing.least_cost([16, 9, 3], (8, 16), 1) == 34


def whole_texts(got):
    """(doc_id, its ids) put together again from packed sequences; documents of equal ids side by side."""
    pieces = defaultdict(list)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) <= r["bin_length"]
        assert r["bin_length"] == min(n for n in packing.LENGTHS if n >= r["n_tokens"])
        at = 0
        for p in r["parts"]:
            assert (p["start"], p["doc_start"]) == (at, p["piece"] * packing.LENGTHS[-1])
            pieces[p["doc_id"], p["piece"]].append(tuple(r["ids"][at : at + p["n"]]))
            at += p["n"]
        assert at == r["n_tokens"]
    return pieces


def test_packed_sequences_hold_every_document(spark, messy, none):
    got = collected(packing.pack_texts(messy, group_tokens=5000))
    want = defaultdict(list)
    for i, ids in expected_ids(messy):
        for piece, at in enumerate(range(0, len(ids), packing.LENGTHS[-1])):
            want[i, piece].append(tuple(ids[at : at + packing.LENGTHS[-1]]))
    found = whole_texts(got)
    assert {k: Counter(v) for k, v in found.items()} == {k: Counter(v) for k, v in want.items()}
    assert len({r["bin_id"] for r in got}) == len(got)
    assert len({r["bin_id"] >> 32 for r in got}) > 3
    assert packing.pack_texts(none).count() == 0


def test_packing_does_not_depend_on_the_layout(messy):
    form = lambda df: Counter((r["bin_id"], r["bin_length"], tuple(map(tuple, r["parts"])), tuple(r["ids"])) for r in df.collect())
    many = messy.select("doc_id", "text").union(messy.select("doc_id", "text").filter("doc_id < 20"))
    assert form(packing.pack_texts(many.repartition(7), group_tokens=3000)) == form(packing.pack_texts(many.coalesce(1), group_tokens=3000))


def test_equal_pieces_are_shared_out(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 200 + [(k, "some other words") for k in range(20)], "doc_id long, text string")
    got = packing.pack_texts(docs, group_tokens=100)
    per_group = Counter()
    for r in got.collect():
        per_group[r["bin_id"] >> 32] += sum(p["doc_id"] == 1 and p["n"] == 4 for p in r["parts"])
    assert sum(per_group.values()) in (200, 201)
    assert len(per_group) == 9 and max(per_group.values()) - min(per_group.values()) <= 2


# ---------------------------------------------------------------- 6


def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, limit=4):
    """Roots by brute force."""
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in root}


def test_simhash(messy):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in messy.select("doc_id", "text").collect()]
    roots = linked({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(messy).collect())
    assert got == Counter((i, f"{f:016x}", least.get(roots[f])) for i, f in rows)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_of_dense_groups(spark, monkeypatch, block):
    """Near copies of a few centres, close to the limit, in groups above and below the sizes of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "STEP", block)
    random_ = random.Random(block)
    prints = set()
    for size in (60, 20, 3, 1, 1):
        centre = random_.getrandbits(64)
        for _ in range(size):
            flips = sum(1 << b for b in random_.sample(range(64), random_.randint(0, 7)))
            prints.add(centre ^ flips)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    df = spark.createDataFrame(signed, "fp long")
    want, links = linked(prints), simhash.near_links(df)
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.components(links).collect()}
    groups = lambda roots: sorted(sorted(f for f in prints if roots.get(f, f) == r) for r in {roots.get(f, f) for f in prints})
    assert groups(found) == groups(want)
    assert all((r["a"] % (1 << 64) ^ r["b"] % (1 << 64)).bit_count() <= 4 for r in links.collect())


def test_crowds_of_near_copies_cost_their_size(spark, monkeypatch):
    """A centre, copies around it in every distance, and strangers, all under one key: links whole, rows few."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    random_ = random.Random(3)
    keep = (1 << 13) - 1 | ((1 << 13) - 1) << 13 | ((1 << 13) - 1) << 26 | ((1 << 13) - 1) << 39  # the first four segments stay
    centre = random_.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in random_.sample(range(52, 64), random_.randint(0, 5))) for _ in range(900)}
    prints |= {centre ^ (random_.getrandbits(64) & ~keep) for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    df = spark.createDataFrame(signed, "fp long")
    links = simhash.near_links(df)
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.components(links).collect()}
    want = linked(prints)
    groups = lambda roots: sorted(sorted(f for f in prints if roots.get(f, f) == r) for r in {roots.get(f, f) for f in prints})
    assert groups(found) == groups(want)
    same = df.select(F.lit(7).cast("long").alias("key"), "fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= simhash.LIMIT
    dealt, stars = simhash._in_blocks(same, ["fp"], "fp", near)
    n = len(prints)
    rest = n - 1 - stars.count()
    assert rest < n / 2
    assert dealt.count() <= (n + 16) * (rest + 16) / 16 * 2
    alone = spark.createDataFrame([(centre % (1 << 60) ^ b,) for b in range(64)], "fp long").select(F.lit(7).cast("long").alias("key"), "fp")
    dealt, stars = simhash._in_blocks(alone, ["fp"], "fp", F.lit(True))
    assert (dealt.count(), stars.count()) == (0, 63)


def test_components(spark):
    random_ = random.Random(2)
    edges = [(random_.randint(0, 300), random_.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (2000, 2000)]
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 7


def test_collision_rate_is_generalised_jaccard():
    n = 40_000
    keys = np.array([11, 22, 33, 44], np.uint64)

    def signature(weights):
        values, signs = weighted_minhash.draw(keys, np.array(weights), n)
        best = values.argmin(0)
        return signs[best, np.arange(n)].astype(int) * 8 + best

    for x, y in (([1, 2, 5, 0.001], [2, 2, 3, 0.001]), ([1, 1, 1, 1], [1, 1, 1, 8]), ([3, 0.5, 2, 7], [3, 0.5, 2, 7])):
        want = sum(map(min, x, y)) / sum(map(max, x, y))
        assert (signature(x) == signature(y)).mean() == pytest.approx(want, abs=0.012)


def test_fingerprints_with_the_next_document(messy, none):
    rows = [(r["doc_id"], r["text"] or "") for r in messy.select("doc_id", "text").collect()]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    sampler, want = weighted_minhash.Sampler(), Counter()
    prints = sampler.fingerprints([t for _, t in rows])
    hexed = lambda p: p.astype(">u2").tobytes().hex()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        other = sampler.fingerprints([new])[0]
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), hexed(prints[k]), hexed(other), float((prints[k] == other).mean()), float((prints[k] == prints[(k + 1) % len(rows)]).mean())] += 1
    for size in (1 << 30, 3000, 100):
        assert Counter(map(tuple, weighted_minhash.fingerprint_with_next(messy, size).collect())) == want
    assert weighted_minhash.fingerprint_with_next(none).count() == 0
    one = weighted_minhash.fingerprint_with_next(messy.filter("doc_id = 5")).collect()
    assert [r["near_next"] for r in one] == [1.0]


def plain_signs(text):
    """The least of each sample over a text's terms, term by term."""
    terms = Counter(text.lower().split()) or {"": 1}
    keys = np.array([xxhash.xxh64_intdigest(w.encode(), weighted_minhash.SEED) for w in terms], np.uint64)
    values, signs = weighted_minhash.draw(keys, np.array([(1 + math.log(n)) * max(1, len(w)) for w, n in terms.items()]))
    return signs[values.argmin(0), np.arange(weighted_minhash.SAMPLES)].tolist()


def test_sampler_against_plain_terms(monkeypatch):
    """Words of every kind, slots that are shared, texts in parts and words that are forgotten."""
    random_ = random.Random(19)
    bits = ["the", "The", "END.", "x" * 30, "日本", "ÉTÉ", "Σας", "\u212a", "\x00", "a\u3000b", "\x85", "İ", "naïve"] + [f"word{k}" for k in range(40)]
    texts = ["".join(random_.choice(bits) + random_.choice(" \n\t\xa0 ") for _ in range(random_.randint(0, 80))) for _ in range(150)] + ["", " "]
    want = [plain_signs(t) for t in texts]
    assert weighted_minhash.Sampler().fingerprints(texts).tolist() == want
    monkeypatch.setattr(weighted_minhash, "ROWS_KEPT", 8)
    monkeypatch.setattr(weighted_minhash.Sampler, "CHUNK", 7)
    sampler = weighted_minhash.Sampler()
    monkeypatch.setattr(sampler.units, "CHARS", 100)
    for _ in range(2):
        assert sampler.fingerprints(texts).tolist() == want
    sampler.units.forget()
    assert sampler.fingerprints(texts[::-1]).tolist() == want[::-1]


# ---------------------------------------------------------------- 8


def pages(spark):
    body = "<p>same</p>"
    rows = [(5, "http://a/5", body), (2, "http://a/2\r\nX: y", body), (9, None, body), (3, "http://a/é", "<p>other</p>"), (4, "http://a/4", None), (6, "http://a/6", ""), (7, "http://a/7", "é" * 70_000), (3, "http://a/é", "<p>other</p>"), (None, "http://a/n", body), (8, "", "x\r\n\r\ny")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(7)).repartition(3), rows


@pytest.mark.parametrize("least", [0, 1, 100])
def test_warc(spark, tmp_path, least):
    df, rows = pages(spark)
    out = f"file://{tmp_path}/w"
    warc.write_archives(df, out, least, 3000)
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(i, first.get(data, i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = first.get(data, i) != i
        want[i, len(data), warc.digest(data), "revisit" if again else "response", first[data] if again else None] += 1
    got = warc.read_archives(spark, out)
    assert Counter(tuple(r) for r in got.drop("url").collect()) == want
    assert {r["url"] for r in got.filter("page_id = 9").collect()} == {None}
    files = sorted((tmp_path / "w/archive").iterdir())
    assert len(files) > 1
    assert not any((tmp_path / "w/_temporary").iterdir())
    again = f"file://{tmp_path}/again"
    warc.write_archives(df, again, least, 3000)
    assert {p.name: p.read_bytes() for p in files} == {p.name: p.read_bytes() for p in (tmp_path / "again/archive").iterdir()}


def test_warc_does_not_depend_on_the_layout(spark, tmp_path):
    """100,000 rows, repeated ids, payloads and rows among them, dealt in two ways: the same files, byte by byte."""
    i = F.col("id")
    df = spark.range(100_000).select(
        F.when(i % 3 == 0, F.lit(5)).otherwise(i * 7919 % 100_003).alias("page_id"),
        F.concat(F.lit("http://h/"), i % 50).alias("url"),
        F.when(i % 10 == 0, "<p>one page that many have</p>").when(i % 11 == 0, "").otherwise(F.repeat(F.concat(F.lit("<p>text "), (i % 40_000).cast("string")), (i % 5 + 1).cast("int"))).alias("html"),
    )
    files = []
    for k, given in enumerate((df.repartition(9), df.coalesce(2).sortWithinPartitions(F.desc("url")))):
        out = f"{tmp_path}/w{k}"
        manifest = warc.write_archives(given, f"file://{out}", file_bytes=100_000, range_bytes=500_000)
        files.append({p: zlib.crc32(open(f"{out}/archive/{p}", "rb").read()) for p in os.listdir(f"{out}/archive")})
        assert sum(r["records"] for r in manifest.collect()) == 100_000
    assert len(files[0]) > 20
    assert len({p.split("-")[1] for p in files[0]}) > 4
    assert files[0] == files[1]


def test_settling_tells_lost_files(spark, tmp_path, monkeypatch):
    df, _ = pages(spark)
    out = f"{tmp_path}/w"
    plain, calls = type(df).mapInArrow, []

    def losing(self, fn, schema, *a):
        calls.append(schema)
        if len(calls) == 2:  # the files are gone before they are settled
            for p in (tmp_path / "w/_temporary").iterdir():
                p.unlink()
        return plain(self, fn, schema, *a)

    monkeypatch.setattr(type(df), "mapInArrow", losing)
    with pytest.raises(Exception, match="neither the file"):
        warc.write_archives(df, f"file://{out}")


def test_ranges_take_hot_keys_apart(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"), F.xxhash64("id").alias("b"), F.lit(10).cast("long").alias("bytes"))
    bounds = common.range_bounds(rows, ["a", "b"], 10_000)
    assert bounds == sorted(set(bounds)) and 20 <= len(bounds) < 30
    assert bounds == common.range_bounds(rows.repartition(7), ["a", "b"], 10_000)
    sizes = [r["count"] for r in rows.groupBy(common.shard_of(["a", "b"], bounds).alias("s")).count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 3000
    same = spark.range(3000).select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.lit(10).cast("long").alias("bytes"))
    assert len(common.range_bounds(same, ["a", "b"], 1000)) <= 1
    assert common.range_bounds(same.limit(0), ["a", "b"], 1000) == []


def test_warc_is_standard_gzip_and_checked(spark, tmp_path):
    import gzip

    df, _ = pages(spark)
    out = f"file://{tmp_path}/w"
    warc.write_archives(df.coalesce(1), out)
    path = max((tmp_path / "w/archive").iterdir(), key=lambda p: p.stat().st_size)
    text = gzip.decompress(path.read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    records = list(warc.members(io.BytesIO(path.read_bytes()), 64))
    assert b"".join(records) == text
    with pytest.raises(ValueError, match="digest"):
        warc.parse(records[1].replace(b"Content-Type: text/html", b"Content-Type: text/htmx"))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(path.read_bytes()[:-9])))
    empty = f"file://{tmp_path}/e"
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


# ---------------------------------------------------------------- 9 and 10


def held_out(spark, sf="/root/testdata/sf0.01"):
    return common.table(spark, sf, "documents"), common.table(spark, sf, "labels"), sf


def test_language_accuracy(spark):
    docs, _, sf = held_out(spark)
    found = language.op9_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() / found.count() > 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0
    for r in found.limit(20).collect():
        assert zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1


def test_language_vectors_are_bound_and_bundled():
    p = language.Profiler(64)
    got, some = p.vectors(["Ab a!", "", None, "42 .,"])
    letters = [0, 1, 2, 0, 1, 0]
    want = sum(p.first[a] * np.roll(p.first[b], 1) * np.roll(p.first[c], 2) for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))
    assert got[0].tolist() == want.tolist()
    assert some.tolist() == [4, 0, 0, 0]
    long = "".join(chr(0x4E00 + k % 3000) + "xyz "[k % 4] for k in range(60_000))
    whole = p.vectors([long])[0]
    parts = p.vectors([long] * 3)[0]
    assert (parts == whole).all()


def plain_vector(p, text):
    """Trigram by trigram: (vector, trigrams)."""
    slots, out = [0], np.zeros(p.size)
    for c in (text or "").lower():
        one = 0
        if c.isalpha():
            one = ord(c) - 96 if "a" <= c <= "z" else 27 + ((ord(c) * 2654435761 >> 11) % (language.LETTERS - 27))
        if one or slots[-1]:
            slots.append(one)
    if slots[-1]:
        slots.append(0)
    for a, b, c in zip(slots, slots[1:], slots[2:], strict=False):
        out += p.first[a].astype(float) * np.roll(p.first[b], 1) * np.roll(p.first[c], 2)
    return out, max(0, len(slots) - 2) if any(slots) else 0


def plain_languages(rows):
    """(prototypes, judge) from (text, lang) rows, one text after the other."""
    p, sums = language.Profiler(), {}
    for text, lang in rows:
        v, n = plain_vector(p, text)
        if lang is not None and n:
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    protos = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}

    def judge(text):
        v, n = plain_vector(p, text)
        if not n or not protos:
            return "und", 0.0, 0.0
        like = {k: float(v @ w) for k, w in protos.items()}
        best = max(like, key=lambda k: like[k])
        return best, min(1, max(0, like[best] / float(np.linalg.norm(v)))), like[best] / n

    return protos, judge


def test_language_against_plain_vectors(spark, messy):
    """The registered query, and what a stage rejects, text by text."""
    docs = common.table(spark, SF, "documents").collect()
    _, judge = plain_languages([(r["text"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1])
    texts = {r["doc_id"]: r["text"] for r in docs}
    got = language.op9_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        lang, score, _ = judge(texts[r["doc_id"]])
        assert r["lang_pred"] == lang
        assert r["score"] == pytest.approx(score, abs=1e-4)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    model = language.language_model(common.table(spark, SF, "documents"))
    odd = [(1, "Кириллица не выучена здесь никогда"), (2, "qzx xqj vvkq zzxq jjqx wqzv kxqz"), (3, texts[5]), (4, None), (5, "12 34"), (6, "")]
    rows = messy.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    kept = Counter(tuple(r) for r in language.in_languages(rows, model).collect())
    assert kept == Counter(tuple(r) for r in rows.collect() if judge(r["text"])[2] >= language.LEAST_LIKENESS)
    assert (3, texts[5]) in kept and not {i for i, _ in odd if i != 3} & {i for i, t in kept if (i, t) in odd}
    only = language.in_languages(rows, model, ("de",)).collect()
    assert Counter(tuple(r) for r in only) == Counter(tuple(r) for r in rows.collect() if judge(r["text"])[2] >= language.LEAST_LIKENESS and judge(r["text"])[0] == "de")


def test_language_odd_rows(spark, messy, none):
    model = language.learn(messy)
    got = language.predict(messy, model, out="p", rate="r")
    assert got.columns == [*messy.columns, "p", "r"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"] == "und") == (not letters)
        assert 0 <= r["r"] <= 1
    nothing = language.learn(none)
    assert nothing == {}
    assert {r["p"] for r in language.predict(messy, nothing, out="p", rate="r").collect()} == {"und"}
    assert language.predict(none, model, out="p", rate="r").count() == 0


def test_every_language_is_learned(spark):
    kinds = {"aa": ("the and with ", 4000), "bb": ("und der mit ", 3000), "cc": ("que los para ", 3), "dd": ("een het voor ", 150), "ee": ("12 ,. ", 500)}
    rows = [(f"{k}{j}", words * 3, k) for k, (words, n) in kinds.items() for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(3)
    model = language.learn(docs, bound=200)
    assert list(model) == ["aa", "bb", "cc", "dd"]
    got = language.predict(docs.filter("lang != 'ee'"), model, out="p", rate="r")
    assert got.filter("p != lang").count() == 0
    assert language._share([4000, 3000, 3, 150], 1000) == 423
    assert language._share([4000, 3000], 10) == language.LEAST_DOCS


def test_quality_held_out(spark):
    docs, labels, sf = held_out(spark)
    found = quality.op10_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in found if r["quality"] == q] for q in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert better > 0.93
    assert sum(s >= 0.3 for s in good) / len(good) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found)


def test_quality_odd_rows(spark, messy, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    weights = quality.train(messy, labels)
    rows = quality.score(messy, weights, out="s").collect()
    assert len(rows) == messy.count()
    assert all(0 <= r["s"] <= 1 for r in rows)
    empties = {r["s"] for r in rows if not squeezed(r["text"])}
    assert len(empties) == 1
    untrained = quality.train(none, labels.limit(0))
    assert {r["s"] for r in quality.score(messy, untrained, out="s").collect()} == {0.5}


def plain_features(text):
    """(place, value) pairs of a text's features, word by word."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    words = [p for w in words for p in ([w] if len(w) <= 24 else [w[k : k + 4] for k in range(0, len(w), 4)])]
    top, out = 1 << 64, []
    core, shape = [], []
    for w in words:
        inner = w
        while inner and not inner[0].isalnum():
            inner = inner[1:]
        while inner and not inner[-1].isalnum():
            inner = inner[:-1]
        core.append(zlib.crc32((inner.lower() or w).encode()))
        marks = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
        shape.append(zlib.crc32("".join(m for k, m in enumerate(marks) if k == 0 or marks[k - 1] != m).encode(), 7))
    pair = lambda a, b, salt: (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + (salt << 43)) % top
    kinds = [core, [pair(a, b, 1) for a, b in zip(core, core[1:], strict=False)], [x + (1 << 40) for x in shape], [pair(a, b, 2) for a, b in zip(shape, shape[1:], strict=False)]]
    kinds.append([pair(pair(a, b, 3), c, 4) for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)])
    kinds += [[(a == b) + (1 << 41) for a, b in zip(core, core[1:], strict=False)], [(a == b) + (1 << 42) for a, b in zip(core, core[2:], strict=False)]]
    for kind in kinds:
        for x in kind:
            x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD % top
            out.append(((x ^ (x >> 29)) % (1 << quality.BITS), 1 / len(kind)))
    return out


def test_quality_against_dense_regression(spark):
    """A model of few rows, trained and scored with plain dictionaries."""
    texts = ["Good plain text about one thing, and another thing.", "BUY!! BUY!! now now now $$$ 99", "", "the end of the day, it's said; is near", "spam spam spam 123 456 SPAM", None, "a", "x" * 40 + " yes", "Words follow words in a sentence that ends.", "!!! ??? ..."] * 2
    rows = [(k, t) for k, t in enumerate(texts)]
    labels = [(k, int("!!" not in (t or "!!") and "spam" not in (t or ""))) for k, t in rows if k % 7]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    dealt = marks.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.SHARDS)).alias("shard"), F.xxhash64("doc_id", F.lit(2)).alias("turn"), "quality").collect()
    final, total = defaultdict(float), len(labels)
    for shard in {r["shard"] for r in dealt}:
        z, n = defaultdict(float), defaultdict(float)
        weight = lambda k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)  # noqa: B023, E731
        mine = sorted((r["turn"], r["doc_id"], r["quality"]) for r in dealt if r["shard"] == shard)
        for _ in range(quality.PASSES):
            for _, i, y in mine:
                x = defaultdict(float)
                for place, value in plain_features(texts[i]):
                    x[place] += value
                x["one"] = 1.0
                w = {k: weight(k) for k in x}
                p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
                for k, v in x.items():
                    g = (p - y) * v
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                    n[k] += g * g
        for k in list(z):
            final[k] += weight(k) * len(mine) / total
    want = {i: 1 / (1 + math.exp(-sum(final[k] * v for k, v in plain_features(t)) - final["one"])) for i, t in rows}
    got = quality.score(docs, quality.train(docs, marks), out="s").collect()
    for r in got:
        assert r["s"] == pytest.approx(want[r["doc_id"]], abs=2e-4)
    assert quality.score(docs.limit(0), quality.train(docs, marks), out="s").count() == 0


def test_products_are_those_of_the_features(monkeypatch):
    """Many texts at once, long words and very long texts in parts."""
    random_, f = random.Random(31), quality.Featuriser()
    weights = np.random.default_rng(5).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    bits = ["the", "The", "END.", "x" * 30, "日本語の文", "a-b", "12,5", "\x00", "naïve", "ﬁ" * 26, "!!", "y" * 25 + "é", "word"]
    texts = ["".join(random_.choice(bits) + random_.choice(" \n\t \x0b  ") for _ in range(random_.randint(0, 40))) for _ in range(200)] + [None, "", " \n", "one", "one two", "日" * 60]
    want = [sum(float(weights[p]) * v for p, v in plain_features(t)) + float(weights[-1]) for t in texts]
    assert f.products(texts, weights) == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(f.units, "CHARS", 60)
    assert f.products(texts, weights) == pytest.approx(want, abs=1e-4)
    for t, w in zip(texts[:50], want, strict=False):
        at, x = f.features(t)
        assert weights[at] @ x + weights[-1] == pytest.approx(w, abs=1e-3)


def test_texts_without_blanks_count_whole():
    f = quality.Featuriser()
    weigh = lambda t: Counter(dict(zip(*(x.tolist() for x in f.features(t)), strict=True)))
    chinese = "".join(chr(0x4E00 + k * 37 % 900) for k in range(400))
    other = chinese[:200] + "".join(chr(0x5E00 + k * 41 % 900) for k in range(200))
    a, b = weigh(chinese), weigh(other)
    assert len(a) > 100 and len(set(a) & set(b)) > 50 and len(set(a) - set(b)) > 50
    assert weigh("x" * 30 + "1-" * 30) != weigh("x" * 30 + "1+" * 30)
    assert quality._shape("1.2.3.4.5.6") == "0.0.0.0.0.0" != quality._shape("1.2.3.4-5-6")
    assert "".join(quality._words(chinese)) == chinese and quality._words("a b" * 2) == ["a", "ba", "b"]


def test_ftrl_by_hand():
    model = quality.Ftrl(3)
    at, x = np.array([1, 3]), np.array([2.0, 1.0])
    model.update(at, x, 1.0)
    g = (0.5 - 1) * x
    assert model.n[at].tolist() == (g * g).tolist()
    assert model.z[at].tolist() == g.tolist()
    w = model.weights(at)
    want = [-(z - np.sign(z) * quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2) for z, n in zip(model.z[at], model.n[at], strict=True)]
    assert w == pytest.approx(want)
    assert model.weights()[[0, 2]].tolist() == [0, 0]


def test_repeated_rows_of_null_text_keep_their_id(spark):
    rows = [(5, None, "x"), (5, None, "x"), (6, "a b c d e", "y"), (6, "a b c d e", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in kept) == [(5, None, "x"), (6, "a b c d e", "y")]


def plain_wide(t):
    """The pipeline's fingerprint, bit by bit: (128 bits, shingles)."""
    words = [w for x in re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if (w := x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))]
    shingles = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(s.encode(), 42), "little") for s in shingles]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), len(shingles)


def wide_linked(prints):
    """Roots of (bits, shingles) by brute force over all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    bits = np.array([[p[0] & (1 << 64) - 1, p[0] >> 64] for p in prints], np.uint64)
    few = np.array([p[1] < 9 for p in prints])
    for k in range(len(prints)):
        near = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(1) <= np.where(few[k + 1 :] | few[k], 0, 25)
        for j in np.flatnonzero(near) + k + 1:
            x, y = find(prints[k]), find(prints[j])
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_near_copies_of_one_id_leave_one_row(spark):
    one, two, three = ("the quick brown fox jumps over", "lorem ipsum dolor sit amet consectetur", "to be or not to be that is")
    rows = [(1, one), (1, one), (2, one), (1, two), (3, two), (4, three), (None, three), (None, "x y z u v w"), (None, "x y z u v w"), (9, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain_wide(t)].append((i is None, i or 0, i, t))
    want = Counter(min(g)[2:] for g in groups.values())
    assert len(groups) == 5
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


@pytest.mark.parametrize("block", [2048, 6])
def test_near_copies_are_found_and_no_others(spark, messy, monkeypatch, block):
    """All pairs by brute force: what goes has a near copy that stays, and nearly all that should go goes."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    random_ = random.Random(11)
    for k in range(300):  # copies with a word in fifty changed
        words = (random_.choice(rows[:900])[1] or "").split()
        for j in range(0, len(words), 50):
            words[random_.randrange(len(words))] = f"other{j}"
        rows.append((100_000 + k, " ".join(words)))
    prints = {i: plain_wide(t) for i, t in rows}
    roots = wide_linked(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    should_go = {i for i, p in prints.items() if least[roots[p]] != i}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    gone = set(prints) - kept
    assert gone <= should_go
    assert len(gone) >= 0.9 * len(should_go) > 200
    # of pairs of similarity 0.8 or more
    shingled = lambda t: {" ".join(w[k : k + 5]) for w in [[x.strip(".,") for x in (t or "").lower().split()]] for k in range(max(1, len(w) - 4))}
    copies = [(i, t) for i, t in rows if i >= 100_000]
    near = [i for i, t in copies if any(len(shingled(t) & s) >= 0.8 * len(shingled(t) | s) for s in [shingled(u) for j, u in rows[:900] if abs(len(u or "") - len(t)) <= 0.1 * len(t) + 20])]
    assert sum(i in gone for i in near) >= 0.9 * len(near) > 50
    odd = simhash.drop_near_duplicates(messy)
    assert odd.columns == messy.columns
    assert 0 < odd.count() < messy.count()


def test_tables_hold_the_chance_to_meet():
    for n in (0, 1, 5000, 10**6, 10**9):
        bits, tables = simhash._tables(n)
        assert 1 - (1 - (1 - simhash.FLIP) ** bits) ** tables >= simhash.MEET
        assert 256 * 2**bits >= min(n, 2**40)


@pytest.mark.parametrize("make", [exact_dedup.exact_duplicates, simhash.near_duplicates, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: bpe.round_trip(d, BYTES, PATTERN)])
def test_empty_tables(none, make):
    assert make(none).count() == 0


def test_no_token_files_of_an_empty_table(spark, none, tmp_path):
    out = f"file://{tmp_path}/t"
    assert token_files.write_token_files(none, out, token_files.encoder_of(WORDS, 1)).count() == 0
    assert token_files.read_token_files(spark, out).count() == 0


def test_heavy_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = spark.createDataFrame([(k % 50 if k % 3 else 1, k) for k in range(600)], "key long, v long")
    groups = rows.filter("key <> 3").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low")).filter("key < 40")
    plain = lambda how: Counter(tuple(r) for r in rows.join(groups.drop("n"), "key", how).collect())
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert Counter(tuple(r) for r in common.split_join(rows, groups, ["key"], how).collect()) == plain(how), how


def test_quality_learns_from_long_texts_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARDS", 1)
    monkeypatch.setitem(spark.sparkContext.environment, "WORKERS", "of this test alone")

    def texts(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                words = np.random.default_rng(i).permutation(20_000)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([" ".join([f"w{w}" for w in words.tolist()])])], names=["doc_id", "text"])

    def most(batches):
        import resource

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10])], names=["mb"])

    docs = spark.range(0, 600, 1, 8).withColumnRenamed("id", "doc_id").mapInArrow(texts, "doc_id long, text string")
    weights = quality.train(docs, spark.range(600).selectExpr("id AS doc_id", "int(id % 2) AS quality"))
    assert np.count_nonzero(weights) > 50_000
    assert spark.range(0, 64, 1, 16).mapInArrow(most, "mb long").agg(F.max("mb")).first()[0] < 500


def test_quality_sums_long_texts_part_by_part(monkeypatch):
    text = " ".join(random.Random(3).choice(["one", "Two", "three,", "4", "x" * 60]) for _ in range(900))
    f = quality.Featuriser()
    whole = f.summed(text)
    monkeypatch.setattr(type(f.units), "CHARS", 500)
    parts = f.summed(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1], rtol=1e-4)


@pytest.mark.parametrize("block", [1 << 18, 150])
def test_no_wide_link_is_missed(spark, monkeypatch, block):
    """Pairs at the very limit, and one bit beyond it."""
    monkeypatch.setattr(simhash, "WIDE_BLOCK", block, raising=False)
    draw = np.random.default_rng(7)
    bits = draw.integers(0, 2, (600, 128), np.uint8)
    for k in range(300):
        bits[300 + k] = bits[k]
        bits[300 + k, draw.permutation(128)[: 25 + (k % 3 == 0)]] ^= 1
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8").tolist()
    classes = spark.createDataFrame([(k, hi, lo, 8 if k % 7 == 0 else 9) for k, (hi, lo) in enumerate(words)], "id long, hi long, lo long, shingles int")
    found = {(min(r), max(r)) for r in simhash.wide_links(classes, 600).distinct().collect()}
    assert found == {(k, 300 + k) for k in range(300) if k % 3 and k % 7 and (300 + k) % 7}


def test_wide_ring_leaves_no_pair_out():
    assert [a for a, _ in simhash.WIDE_RING] == [sum(w for _, w in simhash.WIDE_RING[:k]) for k in range(7)]
    assert sum(w for _, w in simhash.WIDE_RING) == 128
    assert sum(m + 1 for m in simhash.WIDE_MOST) == simhash.WIDE_LIMIT + 1


def test_near_stage_drops_all_that_should_go(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    prints = {r["doc_id"]: plain_wide(r["text"]) for r in docs.collect()}
    roots, least = wide_linked(prints.values()), {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == set(least.values())
