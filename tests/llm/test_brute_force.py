"""Whole tables against plain versions that share no code with the operators, and the cases that once lost rows."""

import hashlib
import html
import re
import time
import zlib
from collections import defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from skyloom.llm import chat_format, common, decontaminate, html_extract, mixing, ngram_join, pseudonyms, quality_classifier, quality_rules, secret_scan, token_output

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Article(HTMLParser):
    """Text of the article element by the standard library's parser: one piece for each block."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.pieces = 0, [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        elif tag in ("nav", "aside", "footer", "form", "script", "style") or dict(attrs).get("class") in ("ad", "comments"):
            self.skip.append(tag)
        if tag == "br":
            self.pieces[-1].append(" ")
        elif tag not in self.INLINE:
            self.pieces.append([])

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag == "article":
            self.inside -= 1
        if tag not in self.INLINE:
            self.pieces.append([])

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.pieces[-1].append(data)


def test_html_whole_table(spark):
    want = {}
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        p = Article()
        p.feed(r["html"] or "")
        p.close()
        want[r["page_id"]] = (r["url"], " ".join(t for t in (" ".join("".join(x).split()) for x in p.pieces) if t))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.query(spark, SF).collect()}
    assert got == {k: (u, t, len(t)) for k, (u, t) in want.items()}


def test_html_broken_pages(spark):
    for page, text in (
        ("<article><p title=it's>One, two. Don't.</p></article>", "One, two. Don't."),
        ('<article><p title="a>b">One</p><p title=a"b>Two</p><p title="never>Three</p></article>', "One Two Three"),
        ("<article><p class='related work'>Rel, ated.</p><p>Text, text.</p><div class=related><p>No</p></div><math><mi>x</mi></math></article>", "Rel, ated. Text, text. x"),
        ("<div id=main><div>" + "Long text, here. " * 20 + "</div><div>Conclusion, at the end of it all.</div></div>", "Long text, here. " * 20 + "Conclusion, at the end of it all."),
    ):
        assert html_extract.extract(page) == text
    for page in ("<div>x" * 100_000, "<div>x" * 50_000 + "</section>" * 50_000, "<h1>x" * 50_000, "<div class=widget>x, y." * 50_000):
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 30
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article>a &amp; b</article>"), (2, "v", "")], "page_id bigint, url string, html string")
    assert sorted(map(tuple, html_extract.extracted(pages).collect()), key=repr) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "a & b", 5), (2, "v", "", 0)], key=repr)
    assert html_extract.extracted(pages.limit(0)).count() == 0
    clash = pages.selectExpr("page_id", "html AS body", "url", "'x' AS text", "1 AS n_chars", "'y' AS html")
    assert {r.text for r in html_extract.extracted(clash, html_col="body").collect()} == {"", "a & b"}


def brute_spans(text):
    """Leftmost non-overlapping matches, and the best window's entropy counted anew for each window."""
    out = []
    for k, p in enumerate((r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(p, text, re.A):
            if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                out.append((m.start(), k, m.end()))
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        t = m[0]
        if not re.search("[0-9]", t) or any(re.search(a, t) for a in secret_scan.ALLOWED):
            continue
        best = 0.0
        for i in range(len(t) - 19):
            n = np.array([t[i : i + 20].count(c) for c in set(t[i : i + 20])]) / 20
            best = max(best, float(-(n * np.log2(n)).sum()))
        is_hex = bool(re.fullmatch("[0-9a-fA-F]+", t))
        if best + 1e-9 >= (3.0 if is_hex else 3.7):
            out.append((m.start(), 3 if is_hex else 4, m.end()))
    return sorted(out)


def test_secrets_whole_table(spark):
    want = {r["doc_id"]: brute_spans(r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    names = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
    say = lambda s, base: ",".join(f"{names[k]}:{a}:{e}" for a, k, e in s if not base or k < 3)
    for r in secret_scan.query(spark, SF).collect():
        s = want[r.doc_id]
        assert r.spans == say(s, False) and r.base_sha256 == hashlib.sha256(say(s, True).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in s) for j in range(3))


def test_secrets_cases(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdef0123456789ABXYZ+/=_- .'\":é😀\n"))
    rows = [(k, "".join(rng.choice(letters, rng.integers(0, 300)))) for k in range(300)] + [(k, f"x{p}={'a1B2' * k} ") for k, p in enumerate(("token", "ApiKey", "api_key' :", "PASSWD"), 400)]
    docs = spark.createDataFrame(rows + [rows[0], (None, "secret=abcdef"), (None, None)], "doc_id bigint, text string")
    got = secret_scan.scan(docs.selectExpr("*", "1 AS found", "2 AS _t")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, [(x.s, x.k, x.e) for x in r.found]) for r in got) == sorted([(k, brute_spans(t)) for k, t in rows + [rows[0]]] + [(-1, [(0, 0, 13)]), (-1, [])])
    for r in secret_scan.redacted(docs).where("doc_id = 400").collect():
        assert "token" not in r.text and "[SECRET]" in r.text


MAIL = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9_])")


def test_pseudonyms_whole_table(spark):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), b"k").collect()}
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymised(spark.createDataFrame([(k, r.text) for k, r in got.items()], "doc_id bigint, text string"), b"k", undo=True).collect()}
    assert back == rows
    linked: dict[str, set[str]] = defaultdict(set)
    for k, t in rows.items():
        own, new = MAIL.findall(t or ""), MAIL.findall(got[k].text or "")
        assert len(own) == len(new) and ("ip:" in got[k].kinds or len(t or "") == len(got[k].text or ""))
        for a, b in zip(own, new):
            linked[a].add(b)
            assert a != b and a.split("@")[1] == b.split("@")[1] and [c.isalpha() for c in a] == [c.isalpha() for c in b]
        assert dict(x.split(":") for x in got[k].kinds.split(",") if x).get("email", "0") == str(len(own))
    assert linked and all(len(v) == 1 for v in linked.values()) and len({b for v in linked.values() for b in v}) == len(linked)


def test_pseudonyms_long_texts(spark):
    for t in ("a." * 300_000, "a@" * 100_000, "x" * 70 + "@mail.example.com", "a" * 100_000 + "@" + "b." * 50_000 + "com", "a@b." + "c" * 300_000, "a@b." + "c" * 300_000 + "_"):
        began = time.time()
        new, found = pseudonyms.replaced(t, b"k")
        assert pseudonyms.replaced(new, b"k", undo=True)[0] == t and time.time() - began < 20
        assert bool(found) == (new != t)
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a@b.example"), (2, "")], "doc_id bigint, text string").selectExpr("*", "1 AS kinds", "2 AS n_private")
    got = sorted(((r.doc_id, r.n_private, r.kinds) for r in pseudonyms.pseudonymised(docs, b"k").collect()), key=repr)
    assert got == sorted([(1, 0, ""), (1, 0, ""), (None, 1, "email:1"), (2, 0, "")], key=repr)
    assert pseudonyms.pseudonymised(docs.limit(0), b"k").count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [(r.score, quality[r.doc_id]) for r in quality_classifier.query(spark, sf).collect() if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    assert len(good) > 5 and len(bad) > 5
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.95
    assert sum((s >= 0.3) == q for s, q in rows) / len(rows) > 0.9


def test_classifier_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 4, f"some words number {k} here.") for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id bigint, quality int")
    assert quality_classifier.scored(docs, quality_classifier.train(docs, labels)).count() == 40


def test_mixing_names_and_order(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "en", "abc"[k % 3], 0) for k in range(200)], SCHEMA).selectExpr("*", "1 AS _copies", "2 AS _copy", "3 AS finish", "4 AS size")
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    ordered = [r.doc_id for r in mixing.mixed_rows(docs, in_order=True).collect()]
    assert sorted(ordered) == sorted(r.doc_id for r in rows.collect())
    times = [(t, r.doc_id) for r in mixing.mix(mixing.sized(docs)).where("taken > 0").collect() for t in (r.finish_0, r.finish_1, r.finish_2)[: r.taken // r.size]]
    assert ordered == [d for _, d in sorted(times)]


def test_decontamination_repeated_rows_in_chunks(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, "en", "a", 0)] * 2, SCHEMA).repartition(2).selectExpr("*", "1 AS block", "2 AS place", "3 AS items")
    items = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 12))) for k in range(10)], "item_id bigint, text string")
    for chunk_bytes in (decontaminate.CHUNK_BYTES, 8):
        got = decontaminate.contamination(docs, items, chunk_bytes=chunk_bytes).collect()
        assert [(r.doc_id, r.spans, len(r["items"])) for r in got] == [(1, [[0, 21]], 10)] * 2
    assert decontaminate.contamination(docs, items.limit(0)).count() == 2 and decontaminate.decontaminated(docs.limit(0), items).count() == 0


def test_paths_of_repeated_messages(spark):
    tree = [(1, k, k - 1 if k else None, 1.0) for k in range(5)]
    rows = spark.createDataFrame(tree * 3 + [(1, 3, 2, 9.0), (None, 1, None, 1.0), (1, None, 2, 99.0)], "tree bigint, id bigint, parent bigint, score double")
    assert sorted((r.tree, r.id, r.depth) for r in chat_format.paths(rows).collect()) == [(1, k, k) for k in range(5)]
    assert chat_format.paths(rows.limit(0)).count() == 0
    assert chat_format.digests(chat_format.conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def test_branching_trees_against_every_path(spark):
    rng = np.random.default_rng(9)
    rows, children = [], defaultdict(list)
    for t in range(20):
        for k in range(int(rng.integers(1, 25))):
            up = int(rng.integers(0, k)) if k else None
            rows.append((t, k, up, float(rng.integers(0, 5))))
            children[t, up].append(k)
    score = {(t, k): s for t, k, _, s in rows}

    def walk(t, k, path):
        if not children[t, k]:
            yield [*path, k]
        for c in children[t, k]:
            yield from walk(t, c, [*path, k])

    for by_mean in (False, True):
        worth = lambda t, p: sum(score[t, k] for k in p) / (len(p) if by_mean else 1)  # noqa: E731, B023
        want = {t: min(walk(t, 0, []), key=lambda p: (-worth(t, p), p[-1])) for t in range(20)}  # noqa: B023
        got = defaultdict(list)
        for r in chat_format.paths(spark.createDataFrame(rows, "tree bigint, id bigint, parent bigint, score double"), by_mean).orderBy("tree", "depth").collect():
            got[r.tree].append(r.id)
        assert got == want


def test_tokens_of_one_id_in_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "RANGE_BYTES", 200)
    rows = [(5, f"text number {k}") for k in range(60)] + [(None, f"none {k}") for k in range(30)] + [(k, f"other {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "2 AS key", "3 AS salt")
    token_output.write(docs, str(tmp_path / "out"))
    got = token_output.with_starts(token_output.read(spark, str(tmp_path / "out")), str(tmp_path / "out")).orderBy("start").collect()
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(-1 if d is None else d for d, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    library = token_output.Encoder(token_output.tokenizer_path()).tokenizer
    assert sorted(np.frombuffer(r.tokens, "<u4").tolist() for r in got) == sorted([*library.encode(t, add_special_tokens=False).ids, 2] for _, t in rows)


def test_other_tokenizers_are_left_to_the_library():
    encoder = token_output.Encoder(token_output.tokenizer_path("byte_bpe_50k.json"))
    texts = ["Hello  World's é", "", None, "\n\t x"]
    assert not encoder.by_words and [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_join_names_and_extreme_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(2**63 - 1, text), (None, text), (None, text), (None, "other words"), (3, None), (2**63 - 1, "other words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS id", "3 AS fp", "4 AS n")
    got = sorted(map(tuple, ngram_join.joined(docs).collect()), key=repr)
    top = 2**63 - 1
    assert got == sorted([(top, 26, top), (None, 26, top), (None, 26, top), (None, 1, top), (3, 0, 3), (top, 1, top)], key=repr)


def test_stored_keeps_the_session_s_batches(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    seen = spark.range(100).selectExpr("repeat('x', 100000) AS t").coalesce(1).mapInArrow(lambda bs: (b.select([0]).slice(0, 1) for b in bs), "t string")
    assert common.stored(seen, "batches").count() > 1
    assert spark.conf.get(limit) == before
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        common.stored(spark.range(1).selectExpr("1 div (id - id) AS x"), "failed")
    assert spark.conf.get(limit) == before


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Session())


def brute_pipeline(docs, items):
    """(doc_id, start, n_tokens, crc32) of the whole pipeline, stage by stage."""
    kept = []
    for d in docs:
        t = d["text"] or ""
        w = words(t)
        grams = defaultdict(list)
        for i in range(len(w) - 7):
            grams[tuple(w[i : i + 8])].append(i)
        repeated = {i + j for x in grams.values() if len(x) > 1 for i in x for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        chars, n = sum(map(len, w)), len(w)
        count = lambda s: sum(c in s for c in t)  # noqa: E731, B023
        fails = (n < 20, 100 * len(repeated) > 30 * n, 100 * count("#*$%&|<>") > 20 * n, 100 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 30 * chars,
                 100 * (len(lines) - len(set(lines))) > 50 * len(lines), chars < 2 * n or chars > 20 * n, 100 * count("!") > 30 * n)
        if not any(fails):
            kept.append(d)
    sets = {d["doc_id"]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d in kept for w in [words(lowered(d["text"]))]}
    own: dict = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            own[g].append(k)
    shared: dict = defaultdict(int)
    for ks in own.values():
        for a in ks:
            for b in ks:
                shared[a, b] += a < b
    label = {k: k for k in sets}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for (a, b), c in shared.items():
        if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = top(a), top(b)
            label[max(x, y)] = min(x, y)
    kept = [d for d in kept if top(d["doc_id"]) == d["doc_id"]]
    cut = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", lowered(t))
    windows: dict = defaultdict(set)
    for r in items:
        w = cut(r["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[len(w[i : i + 10])].add(tuple(w[i : i + 10]))
    kept = [d for d in kept if not any(tuple(w[i : i + n]) in x for w in [cut(d["text"])] for n, x in windows.items() for i in range(len(w) - n + 1))]
    by: dict = defaultdict(list)
    for d in kept:
        by[d["source"]].append((hashlib.md5(f"{d['doc_id']}:{mixing.SEED}".encode()).hexdigest(), d["doc_id"], len(words(d["text"]))))
    size = {s: sum(n for _, _, n in x) for s, x in by.items()}
    weigh = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    aim, open_, left = {}, dict(weigh), Fraction(sum(size.values()))
    while True:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * size[s]]
        if not over:
            break
        for s in over:
            aim[s] = Fraction(3 * size[s])
        left -= sum(3 * size[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    aim.update({s: left * w / sum(open_.values()) for s, w in open_.items()})
    queue = []
    for s, x in by.items():
        base = 0
        for _, k, n in sorted(x):
            base += n
            queue += [((e * size[s] + base) / float(aim[s]), k, e, n) for e in range(3)]
    mix, used = [], 0
    for _, k, _, n in sorted(queue):
        used += n
        if used > sum(size.values()):
            break
        mix.append(k)
    text = {d["doc_id"]: d["text"] for d in kept}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.tokenizer_path())
    out, start = [], 0
    for k in sorted(mix):
        ids = np.array([*tokenizer.encode(text[k], add_special_tokens=False).ids, 2], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    sf_dir = f"/root/testdata/{sf}"
    want = brute_pipeline(pq.read_table(f"{sf_dir}/documents.parquet").to_pylist(), pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist())
    got = corpus_pipeline.run(spark, sf_dir)
    assert len(want) > 50 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_html_unescapes_as_the_library():
    assert html_extract.extract("<article>&lt;b&gt; &copy &#65; &nosuch;</article>") == html.unescape("<b> &copy &#65; &nosuch;")


@pytest.mark.parametrize("name", ["op4_secret_scan", "op10_ngram_join"])
def test_sql(spark, name):
    from oracle import compare
    from skyloom.llm import registry

    compare(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert quality_rules.ledger(spark.createDataFrame([(None, None)], "doc_id bigint, text string")).first().fail_bits & 1
