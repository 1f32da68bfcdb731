"""The operators' queries against plain brute-force versions, over whole tables and over awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskgauge.llm import byte_bpe, chat, licenses, media_avi, near_text, near_vectors, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, class string, component string"
TEXTS = [None, "", " \n\t", "one", "a b c d", "a b c d", "A B C D", "x " * 9, "é ß 漢字 " * 40, "word" * 20000, "The MIT License. mit  license!",
         "GNU General Public License / general public", "Apache-License apache license mit license", "the quick brown fox jumps over the lazy dog again and again",
         "<|im_end|> &lt;| &amp; \\", "it's 12345 \u00a0\u2028 ok\r\n"]
#: nulls, ties, repeated rows, long texts and columns whose names the operators use within.
ROWS = [(i, t, "en", "s", 1, 7, "c", None) for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None, None, None, None), (None, "lost words of no row at all", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def least(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_text(which, request):
    df = request.getfixturevalue(which)
    data = [(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))]
    sets = {i: shingle_set(t) for i, t in data if i is not None}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = least(sets, links)
    got = rows(near_text.near_duplicates(df))
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])


def test_near_text_large_group_is_compared_in_blocks(spark):
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(600):
        w = list(base)
        w[(i * 7) % 190] = f"x{i}"
        data.append((i, " ".join(w)))
    got = rows(near_text.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {r["component_id"] for r in got} == {0}


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[0] + 0.05 * rng.standard_normal((100, 16))
    x[200:210] = x[5]
    x[210] = 3 * x[6]
    data = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (905, [], None), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0)]
    got = {r["vec_id"]: r for r in rows(near_vectors.near_duplicates(spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, pivot int")))}
    u = np.array([d[1] for d in data], dtype=np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = u @ u.T >= 0.95
    want = least(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(c), strict=True)])
    assert all(got[i]["n_links"] == c[i].sum() - 1 and got[i]["component_id"] == want[i] for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert (got[907]["n_links"], got[907]["component_id"]) == (1, 906)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_licenses(which, request):
    df = request.getfixturevalue(which)
    want = []
    for r in rows(df.select("doc_id", "text")):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        at, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            base |= {label} if here else set()
        want.append((r["doc_id"], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base))))
    got = rows(licenses.license_report(df))
    assert sorted(map(str, want)) == sorted(str(tuple(r[k] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))) for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_notice_with_changes(spark):
    notice = licenses.NOTICES["mit-notice"].split()
    changed = notice[:6] + ["kindly"] + notice[6:14] + notice[15:]
    df = spark.createDataFrame([(1, "x y z " + " ".join(changed) + " end", 0), (2, " ".join(notice[:5]), 0)], "doc_id long, text string, label int")
    assert {r["doc_id"]: r["labels"] for r in rows(licenses.license_report(df))} == {1: "mit-notice", 2: ""}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_byte_bpe(which, request):
    import tiktoken

    df = request.getfixturevalue(which)
    path, pattern = byte_bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = []
    for r in rows(df.select("doc_id", "text")):
        t = r["text"] or ""
        ids = enc.encode_ordinary(t)
        want.append(str((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())))
    assert sorted(want) == sorted(str(tuple(r.values())) for r in rows(byte_bpe.digests(df, path, pattern)))


def test_byte_bpe_ids_and_long_pieces(spark):
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    bpe = byte_bpe.Bpe(byte_bpe.load_ranks(path), pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in ("a" * 5000, "ab" * 3000, "漢字" * 800, "".join("abcd"[(i * i) % 4] for i in range(9000))):
        assert bpe.encode(t) == enc.encode_ordinary(t) and bpe.decode(bpe.encode(t)) == t.encode()
    ids = byte_bpe.encode_texts(spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"), path, pattern)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in rows(byte_bpe.decode_ids(ids, path, pattern))} == {1: b"some text", 2: b""}


def chat_wanted(data):
    convs = defaultdict(list)
    for c, t, role, text in data:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(2048, 256), (64, 16), (8, 0)])
def test_chat(spark, budget, history):
    odd_turns = [(7, 0, "system", "s&amp;<|im_start|>"), (7, None, "user", None), (7, 1, "assistant", "a" * 300), (7, 1, "assistant", "a" * 300), (7, 2, None, "x\n<|im_end|>\n"), (8, 0, "system", "only"), (None, 0, "assistant", "&#10;&lt;|é漢"), (9, 0, "us\ner", "")]
    table = [tuple(r.values()) for r in rows(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text"))]
    for data in (odd_turns, table):
        df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
        w = chat.windows(df, budget, history)
        got = {r["conv_id"]: r for r in rows(chat.digests(w))}
        want = chat_wanted(data)
        assert {c: tuple(r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for c, r in got.items()} == want
        for r in rows(w):
            assert all("<|" not in r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in rows(chat.op9(spark, SF))}
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["loss_chars"] == len(said) and got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_media(which, request):
    df = request.getfixturevalue(which)
    want = []
    for r in rows(df.select("doc_id", "text")):
        b = (r["text"] or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        want.append(str((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))))
    got = rows(media_avi.digests(df))
    assert sorted(want) == sorted(str(tuple(r[k] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))) for r in got)


def test_media_files_and_clips(spark):
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 576 * 40, dtype=np.uint8).tobytes()
    for p in (raw, bytes([0, 255]) * 288, b"\xff" * 576):
        samples, bounds = media_avi.read_avi(media_avi.write_avi([p, p]))
        assert samples[: bounds[1]].tobytes() == p and samples[bounds[1] :].tobytes() == p
    text = "a" * 576 * 20 + "zyxw" * 144 * 20
    media = media_avi.store(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    got = sorted(tuple(r.values()) for r in rows(media_avi.clips(media)))
    assert got == [(1, 0, 0, 20, 0.0, 20 / 12), (1, 1, 20, 40, 20 / 12, 40 / 12), (2, 0, 0, 1, 0.0, 1 / 12)]
    with pytest.raises(ValueError):
        media_avi.index_of(b"RIFFnothing at all")


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fits = [(len(r), r) for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1] if fits else None


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    extra = ["", None, "no scheme", "://", "HTTP://A.COM/en/x?y#z", "http://com/en/", "x://net?de/", "a://b://c/de/", "http://example.net/de/8#q", "http://EXAMPLE.com/en/7", "http://xcom/en/", "http://a.org/es/\nb"]
    df = pages.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(extra)], "page_id long, url string"))
    verdict = {r: v for v, r in urls.RULES}
    data = {r["page_id"]: r["url"] for r in rows(df)}
    got = rows(urls.judge(df))
    assert len(got) == len(data)
    for r in got:
        host, path, rule = plain_rule(data[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), data[r["page_id"]]
        assert r["verdict"] == (verdict[rule] if rule else "block" if r["score"] >= 0.5 else "allow")


def test_url_trees_learn_the_labels(spark):
    got = rows(urls.judge(spark.read.parquet(f"{SF}/pages.parquet")))
    ruled = [r for r in got if r["rule"]]
    assert np.mean([(r["score"] >= 0.5) == (r["verdict"] == "block") for r in ruled]) > 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, vec_id long, embedding array<float>, page_id long, url string, conv_id long, turn long, role string")
    path, pattern = byte_bpe.public_vocabulary()
    for df in (near_text.near_duplicates(none), near_vectors.near_duplicates(none), licenses.license_report(none), byte_bpe.digests(none, path, pattern), media_avi.digests(none), urls.judge(none), chat.digests(chat.windows(none))):
        assert df.collect() == []


def test_near_vectors_dense_group_loses_no_link(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 64))
    x[:2000] = rng.standard_normal(64) + 0.2 * rng.standard_normal((2000, 64))  # mean cosine .96: links and near misses
    got = {r["vec_id"]: r for r in rows(near_vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")))}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u @ u.T >= 0.95
    want = least(range(6000), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(c, 1)), strict=True)])
    assert all(got[i]["n_links"] == c[i].sum() - 1 and got[i]["component_id"] == want[i] for i in range(6000))


def test_license_notices_need_their_telling_words(spark):
    mit = licenses.NOTICES["mit-line"]
    texts = {"released under the bsd license": "", "a film released under the title of dusk": "", "licensed under CC BY-SA 4.0": "", "licensed under CC BY 4.0": "", "licensed under CC BY-NC-SA 4.0": "",
             "this work is licensed under the gnu lesser general public license version 3": "", "licensed under CC BY-NC 4.0": "cc-by-nc", f"x {mit} y": "mit,mit-line",
             f"{licenses.NOTICES['bsd-notice']} " * 3: "bsd-notice", "of the software and of the " * 40 + licenses.NOTICES["mit-notice"] + " in the software of this" * 40: "mit-notice"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in rows(licenses.license_report(df))}
    own = {k: ",".join(x for x in v.split(",") if x != "gpl") for k, v in got.items()}  # the base phrase stands in the lesser licence too
    assert own == dict(enumerate(texts.values()))
