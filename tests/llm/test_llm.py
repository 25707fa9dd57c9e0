"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()


def docs(spark, rows, **more):
    """Documents of (id, text), with a column whose name clashes with the operators' own."""
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TEXT)
    return frame.withColumn("spans", F.lit("mine")).withColumn("fp", F.lit("x")).withColumn("row", F.lit(1))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "x" * 5000), (4, "x" * 5000), (5, "é日 \U0001f600 mixed")]


# SimHash


def brute_simhash(text):
    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not found:
        return 0
    grams = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("max_list,t", [(1 << 16, None), (8, 2), (1 << 16, 3), (16, 4)])
def test_simhash_components(spark, max_list, t):
    from lodeseek.llm.components import components
    from lodeseek.llm.simhash import linked_pairs

    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:4]:  # chains and dense groups
        now = base
        for _ in range(60):
            now ^= 1 << rng.randrange(64)
            now ^= 1 << rng.randrange(64)
            fps.append(now if rng.random() < 0.5 else base ^ 1 << rng.randrange(64) ^ 0)
    fps = sorted(set(fps))
    want = defaultdict(set)
    for f, r in zip(fps, brute_components(fps)):
        want[r].add(f)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = linked_pairs(spark.createDataFrame(signed, "fp long"), max_list=max_list, t=t)
    got = defaultdict(set)
    for row in components(links).collect():
        got[row["root"]].add(int(np.int64(row["node"]).view(np.uint64)))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_simhash_documents(spark):
    from lodeseek.llm.simhash import near_duplicates, simhash

    rng = random.Random(3)
    rows = [(10 + i, prose(rng, rng.choice([1, 3, 4, 5, 50, 300]))) for i in range(30)]
    rows += [(100 + i, t.upper()) for i, (_, t) in enumerate(rows[:10])] + [(7, rows[0][1])]
    rows += [r for r in ODD if r[0] is not None]
    for _, t in rows:
        assert simhash(None if t is None else t.encode()) == brute_simhash(t)
    fps = [brute_simhash(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    got = near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, least[r]) for (i, _), r in zip(rows, roots))
    assert near_duplicates(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in near_duplicates(docs(spark, [(None, "a"), (None, "a")])).collect()] == [None, None]


# Packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodeseek.llm.packing import encoder, pack

    rng = random.Random(1)
    rows = [(10 + i, prose(rng, rng.choice([1, 30, 400, 3000])) + rng.choice(["", " é日", "<|endoftext|> x", "\n\n  'll"])) for i in range(40)]
    rows += [r for r in ODD if r[0] not in (None, 4)]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: slow.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    assert all(encode(t or "") + [1] == want[i] for i, t in rows)
    got = pack(docs(spark, rows).repartition(3)).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(ids) and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], ids))
        windows[r["sequence_id"]].append((r["offset"], len(ids)))
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in pieces.items()} == want
    for parts in windows.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == 2048 or at.bit_count() == 1
    assert pack(docs(spark, [])).count() == 0
    assert pack(docs(spark, [(4, "a"), (4, "a"), (None, None)])).count() == 3


def test_packer_level_is_least_sum_of_squares():
    from lodeseek.llm.packing import Packer

    rng = random.Random(5)
    packer = Packer(64)
    for key in range(300):
        size = rng.randrange(1, 64)

        def cost(h):
            counts = packer.counts.copy()
            if h:
                counts[h] -= 1
            if h + size < 64:
                counts[h + size] += 1
            return int((counts[1:64] ** 2).sum())

        chosen = packer.level(size)
        assert cost(chosen) == min(cost(h) for h in range(0, 64 - size + 1) if h == 0 or packer.counts[h])
        list(packer.put(key, np.zeros(size, "<u4")))


# Decontamination


def brute_contamination(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        size = min(13, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_contamination(spark, block_bytes):
    from lodeseek.llm.decontaminate import contamination

    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 12, 5, 2, 1, 30])] + [(7, "one word, UPPER."), (8, ""), (9, None), (0, "other text of a repeated id")]
    rows = [(20 + i, prose(rng, 60)) for i in range(10)]
    rows += [(40, items[0][1].upper()), (41, prose(rng, 50) + " " + " ".join(items[0][1].split()[3:20])), (42, "x ONE. word upper"), (43, " ".join(items[6][1].split()[5:17]))]
    rows += ODD
    bench = spark.createDataFrame([*items, (None, "null id")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = contamination(docs(spark, rows), bench, block_bytes=block_bytes).collect()
    key = lambda x: (str(x[0]), x[1:])
    want = [(i, *brute_contamination(t, items)) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=key) == sorted(want, key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    carried = contamination(docs(spark, rows), bench, carry=True).select("row.*")
    assert carried.columns == docs(spark, rows).columns and carried.count() == len(rows)
    assert contamination(docs(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert contamination(docs(spark, []), bench).count() == 0


# WARC


def test_warc(spark, tmp_path):
    from lodeseek.llm.warc import fetch, read_bundles, write_bundles

    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "<p>" + prose(rng, 40) + "é</p>") for i in range(60)]
    rows += [(100 + i, None, rows[3][2]) for i in range(20)] + [(200, "a\r\nb", None), (201, "", ""), (None, "n", "null id"), (202, "big", "y" * 300_000), (300, "r", "twice"), (300, "r", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)
    root = f"file://{tmp_path}/warc"
    index = write_bundles(pages, root, bundle_bytes=50_000, frame_bytes=8_000)
    last = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = i if last[h or ""] is None else max(i, last[h or ""])
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = i is not None and last[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None, None if revisit else h or ""))
    got = [tuple(r) for r in read_bundles(index, root).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for place in index.filter("id IN (5, 202)").collect():
        headers, block = fetch(place.asDict(), root)
        assert headers["WARC-Record-ID"] == f"<urn:page:{place['id']}>" and block.partition(b"\r\n\r\n")[2].decode() == dict((i, h) for i, _, h in rows)[place["id"]]
    empty = write_bundles(pages.limit(0), f"file://{tmp_path}/none")
    assert read_bundles(empty, f"file://{tmp_path}/none").count() == 0


def test_warc_least(spark):
    from lodeseek.llm.warc import archive

    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in archive(pages, least=5).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


# Secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(t):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secret_scan_equals_regex():
    from lodeseek.llm.secrets import code_points, scan

    rng = random.Random(1)
    parts = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0a1b2c3d" * 4, "abcdef01", "x", "é", "日", "\n", ".", "token=", "Z9"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert [x for x in code_points(t.encode(), scan(t.encode())) if x[2] < 3] == brute_base(t)


MORE_RULES = (  # kind, what matches, what of it counts
    ("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"), ("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"), ("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]+", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{6,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{8,}", None), ("url_login", "[a-z]://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+=-]+@", None),
)


def test_more_rules_equal_regex():
    from lodeseek.llm.secrets import BASE, MORE, scan

    kinds = [r.kind for r in BASE + MORE]
    rng = random.Random(2)
    parts = ["ghp_", "gho_", "A1b2C3d4" * 5, "xoxb-", "AIza", "sk_live_", "rk_test_", "eyJ", "hbGciOi", ".", ":", "@", "://", "http", "bob", "-", "_", " ", "0a1b2c3d" * 4, "token=", "AKIA", "\n", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24))).encode()
        want = [(m.start(), m.end(), k) for k, form, counts in MORE_RULES for m in re.finditer(form.encode(), t) if counts is None or re.fullmatch(counts.encode(), m[0])]
        got = [(s, e, kinds[r]) for s, e, r in scan(t) if kinds[r] in [k for k, *_ in MORE_RULES]]
        assert sorted(got) == sorted(want), t


def test_more_secrets(spark):
    from lodeseek.llm.secrets import redacted, secret_spans

    rows = [
        (10, "é ghp_" + "a1B2" * 9 + " end"), (11, "-----BEGIN RSA PRIVATE KEY----- x"), (12, "see https://bob:hunter2@host/ now"), (13, "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl"),
        (14, "plain text about a password and a token."), (15, "password = 'abcdefgh1'"),
    ] + ODD
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_spans(docs(spark, rows)).collect()}
    assert got[10] == [("github", 2, 42)] and got[11] == [("private_key", 0, 31)] and [k for k, *_ in got[12]] == ["url_login"] and [k for k, *_ in got[13]] == ["jwt"]
    assert got[14] == got[1] == got[2] == [] and got[15] == [("assign", 0, 21)]
    clean = redacted(docs(spark, rows))
    assert clean.columns == docs(spark, rows).columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[10] == "é <github> end" and texts[14] == rows[4][1] and texts[1] is None and texts[15] == "<assign>'"
    assert secret_spans(docs(spark, [])).count() == 0


# URL filters


def test_url_verdicts(spark):
    from lodeseek.llm.urlfilter import RULES, url_verdicts

    urls = [
        "http://A.Example.com/en/1?x", "https://www.example.com/en/2", "http://b.www.example.com/en/", "http://x.net/es/1", "http://x.net/de/1#f", "http://net/fr/", "http://xnet/fr/",
        "http://example.com", "no scheme", None, "", "ftp://h?://y", "http://a.org/" + "d/" * 60 + "1", "http://h.com\n/a\nb?c", "a://b://c/d",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[3])]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("mine"))).collect()

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, best and best[1] + best[2], best[0] if best else "allow"

    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got], key=str) == sorted([(i, *brute(u)) for i, u in rows], key=str)


def test_url_tree_carries_labels(spark):
    from lodeseek.llm.urlfilter import url_verdicts

    rows = [(i, f"http://h.test/shop{'abc'[i % 3]}/item/{i}") for i in range(60)] + [(100 + i, f"http://h.test/news/{i}") for i in range(40)] + [(200 + i, f"http://h.test/u{i}x/q/{i}") for i in range(400)]
    rules = (("block", "h.test", "/shopa/item/1"), ("block", "h.test", "/shopa/item/3"), ("block", "h.test", "/shopa/item/9"), ("allow", "h.test", "/news/1"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[6] == (None, "block")  # same template as the blocked ones
    assert got[102] == (None, "allow") and got[1] == (None, "allow") and got[210] == (None, "allow")
    assert len(got) == len(rows)


def test_tree_goes_on_below_wildcards(spark):
    """Variable user names above /spam/ and /good/: the branches below the wildcard are told apart."""
    from lodeseek.llm.urlfilter import url_verdicts

    names = [a + b for a in "abcdefghijklm" for b in "nopqrstuvwxyz"]
    rows = [(i, f"http://h.test/{u}/{kind}/i{i}") for i, (u, kind) in enumerate((u, k) for _ in range(2) for u in names for k in ("spam", "good"))]
    rules = tuple(("block", "h.test", f"/{u}/spam") for u in names[:8]) + tuple(("allow", "h.test", f"/{u}/good") for u in names[:8])
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).filter("rule IS NULL").collect()
    verdicts = defaultdict(set)
    for r in got:
        verdicts[r["path"].split("/")[2]].add(r["verdict"])
    assert verdicts == {"spam": {"block"}, "good": {"allow"}} and len(got) == 2 * 161 * 2


def brute_templates(rows, share, least, z, prior, purity):
    """rows: (host, segments, n, labelled, blocked) -> rejected (host, segments), by plain recursion over branches."""
    bad = set()

    def grow(host, members, depth):
        ended = [m for m in members if len(m[1]) == depth]
        if depth and sum(m[4] for m in ended) / (sum(m[3] for m in ended) + prior) >= purity:
            bad.update((host, m[1]) for m in ended)
        below, total = defaultdict(list), 0
        for m in members:
            if len(m[1]) > depth:
                below[m[1][depth]].append(m)
                total += m[2]
        branches, rated = defaultdict(list), []
        for seg, own in below.items():
            n, labelled, blocked = (sum(m[k] for m in own) for k in (2, 3, 4))
            if n < least or n < share * total:
                branches["*"] += own
            elif labelled < least:
                branches[seg] += own
            else:
                rated.append((blocked / labelled, seg, labelled, blocked, own))
        groups = []
        for rate, seg, labelled, blocked, own in sorted(rated, key=lambda x: x[:2]):
            if groups:
                a, b, _ = groups[-1]
                pooled = (b + blocked) / (a + labelled)
                if abs(rate - b / a) <= z * math.sqrt(pooled * (1 - pooled) * (1 / a + 1 / labelled)):
                    groups[-1] = (a + labelled, b + blocked, groups[-1][2] + own)
                    continue
            groups.append((labelled, blocked, own))
        for members in [*branches.values(), *(g[2] for g in groups)]:
            grow(host, members, depth + 1)

    for host in {r[0] for r in rows}:
        grow(host, [r for r in rows if r[0] == host], 0)
    return bad


def test_rejected_templates(spark):
    from lodeseek.llm.urlfilter import rejected_paths

    rng = random.Random(3)
    rows = {}
    for _ in range(700):
        segs = tuple(rng.choice(["a", "b", "c", f"u{rng.randrange(300)}"]) for _ in range(rng.choice([0, 1, 2, 2, 3, 4])))
        labelled = rng.randrange(8)
        rate = 0.95 if "a" in segs[:2] else 0.1
        rows[(rng.choice("hg"), segs)] = (labelled + rng.randrange(3) + 1, labelled, sum(rng.random() < rate for _ in range(labelled)))
    rows = [(h, s, *x) for (h, s), x in rows.items()]
    frame = spark.createDataFrame([(h, list(s), *x) for h, s, *x in rows], "host string, segs array<string>, n long, labelled long, blocked long")
    for options in ((0.01, 5, 1.96, 2.0, 0.8), (0.05, 3, 1.0, 2.0, 0.6)):
        got = {(r["host"], tuple(r["segs"])) for r in rejected_paths(frame, *options).collect()}
        assert got == brute_templates(rows, *options) and got


# MaxScore


def brute_top(vectors, k, every):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(kept) if other != at)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(2048, 2048), (16, 3)])
def test_top_k(spark, shard_rows, block_rows):
    from lodeseek.llm.maxscore import top_k

    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) * (3 if d < 2 else 1) for d in range(24)]) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(12)] + [(50, rows[50][1]), (50, rows[3][1])]
    rows += [(None, rows[0][1]), (500, None), (501, [None, 1.0]), (502, [float("nan")]), (503, [float("inf")]), (504, []), (505, [0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("mine"))
    got = sorted(tuple(r) for r in top_k(frame.repartition(3), every=10, shard_rows=shard_rows, block_rows=block_rows).collect())
    assert got == brute_top(rows, 5, 10)
    assert top_k(frame.limit(0)).count() == 0
    assert [tuple(r) for r in top_k(frame.filter("vec_id IN (10, 11)"), every=10).select("query_id", "rank", "vec_id").collect()] == [(10, 1, 11)]


def test_thresholds_are_carried_over_shards():
    """A threshold makes dimensions non-essential and skips whole shards, and changes no result."""
    from lodeseek.llm.maxscore import Running, first_floors

    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 60, (600, 16)))
    x[300:] = np.floor(x[300:] / 20)  # shards that cannot compete
    q = x[:40]
    floors = first_floors(q, 6)
    assert all(f == sorted(q @ y)[-6] for f, y in zip(floors, q))
    taken = {}
    for name, start in (("with", floors), ("without", np.full(40, -np.inf))):
        running = Running(np.arange(40), q, start, 6)
        taken[name] = sum(running.take(np.arange(at, at + 50), x[at : at + 50]) for at in range(0, 600, 50))
        for at in range(40):
            order = sorted(range(600), key=lambda i: (-(x[i] @ q[at]), i))[:6]
            assert running.got[at][0].tolist() == order
    assert taken["with"] <= taken["without"] < 40 * 12


def test_top_k_of_large_components(spark):
    from lodeseek.llm.maxscore import top_k

    rows = [(i, [float(i * 10**5 + d) for d in range(4)]) for i in range(20)]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect())
    whole = [(i, [256 * int(x) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    assert got == sorted(want)


# Token counts


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    from lodeseek.llm.tokencount import Counter, token_counts, unigram

    scores, missing = unigram(public_tokenizers.path("piece_bpe_32k.model"))
    longest = max(map(len, scores))

    def brute(word):  # plain forward recurrence over all pieces
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if piece in scores:
                    options.append((best[start] + scores[piece], -start, count[start] + 1))
                elif start == end - 1:
                    options.append((best[start] + missing, -start, count[start] + len(piece.encode())))
            top = max(options, key=lambda o: (o[0], o[1]))
            best.append(top[0])
            count.append(top[2])
        return count[-1]

    rng = random.Random(6)
    rows = [(10 + i, prose(rng, 50) + " " + "".join(rng.choice("abcdeé日\U0001f600xyz") for _ in range(30))) for i in range(20)] + ODD
    want = sorted((str(i), len((t or "").split()), sum(brute("▁" + w) for w in (t or "").split())) for i, t in rows)
    for words, long_word in ((400_000, 256), (50, 8), (0, 10_000)):
        got = sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in token_counts(docs(spark, rows), max_words=words, long_word=long_word).collect())
        assert got == want
    known = WORDS
    other = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], unk_id=0))  # an independent implementation
    found = Counter(scores, missing).counts([w.encode() for w in known], 256)
    assert [found[w.encode()] for w in known] == [len(other.encode("▁" + w).ids) for w in known]


# Quality


def test_quality_held_out(spark):
    from lodeseek.llm.quality import graded, scored, train

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        text, kind = prose(rng, 60), i % 3
        if kind == 0:
            words = text.split()
            words[rng.randrange(60)] = rng.choice(["idiot", "scum", "moron"])
            text = " ".join(words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((10 + i, text))
        if i < 600:
            labels.append((10 + i, int(kind != 1), int(kind == 0)))
    table = spark.createDataFrame([*labels, (10, None, None), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows + ODD)
    model = train(frame, graded(table))
    got = {r["row"]["doc_id"]: r for r in scored(frame, model).collect()}
    held = [(i, got[10 + i]) for i in range(600, 900)]
    assert sum(r["keep"] == (i % 3 == 2) for i, r in held) / len(held) > 0.95
    mean = [np.mean([r["expected_grade"] for i, r in held if i % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert (np.diff(model.thresholds) > 0).all() and set(got) == {i for i, _ in rows + ODD}
    none = train(frame, graded(table.limit(0)))
    assert scored(frame, none).filter("keep AND p_tail IS NULL").count() == len(rows + ODD)
    assert scored(docs(spark, []), model).count() == 0


# Licences


def test_licenses(spark):
    from lodeseek.llm.licenses import GRANT, HINT, SENTENCES, license_scan

    assert all(re.search(HINT, s) for s in SENTENCES) and all("," not in i for i in SENTENCES.values())
    assert all(re.sub(GRANT, "under ", s) == s for s in SENTENCES)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [
        (10, "Some text\nReleased under the MIT License.\nmore text"), (11, "This work is licensed under the GNU General Public License, version 3."), (12, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (13, mit), (14, "He was licensed to drive under the bridge."), (15, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at x"),
    ] + ODD
    got = {r["doc_id"]: (list(r["sentence_ids"]), list(r["licenses"])) for r in license_scan(docs(spark, rows)).collect()}
    assert got[10][1] == ["MIT"] and got[11][1] == ["GPL-3.0"] and got[12] == (["CC-BY-NC-4.0~", "Apache-2.0~"], ["Apache-2.0", "CC-BY-NC-4.0"])
    assert got[13] == (["mit-grant", "mit-notice"], ["MIT"]) and got[14] == ([], []) and got[15][1] == ["Apache-2.0"] and got[1] == got[2] == ([], [])
    assert license_scan(docs(spark, [])).count() == 0


def test_a_taken_run_parts_its_neighbours(spark):
    from lodeseek.llm.licenses import licences

    rows = [(["bsd-grant", "bsd-source", "isc-grant", "bsd-binary"], ["ISC"]), (["MIT~", "MIT~"], ["MIT"]), (["bsd-grant", "bsd-source", "bsd-binary", "isc-grant"], ["ISC", "BSD-2-Clause"]), ([], [])]
    frame = spark.createDataFrame([(n, ids) for n, (ids, _) in enumerate(rows)], "n int, ids array<string>")
    got = {r["n"]: list(r["found"]) for r in frame.select("n", licences(F.col("ids")).alias("found")).collect()}
    assert got == {n: want for n, (_, want) in enumerate(rows)}


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lodeseek.llm.quality import graded, scored, train
    from lodeseek.llm.secrets import scan
    from test_near_copies import brute_kept

    source = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, source).collect()
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{source}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    frame = spark.read.parquet(f"{source}/documents.parquet")
    model = train(frame, graded(spark.read.parquet(f"{source}/labels.parquet")))
    kept = sorted(r["doc_id"] for r in scored(frame, model).filter("keep").select("row.doc_id").collect())
    kept = brute_kept([(i, table[i]["text"]) for i in kept])
    clean = []
    for i in kept:
        n, hit, _ = brute_contamination(table[i]["text"], items)
        long_items = [(k, t) for k, t in items if len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t or "")) >= 13]
        full = brute_contamination(table[i]["text"], long_items)[1] > 0
        if not (full or hit and 20 * hit >= n):
            clean.append(i)
    assert sorted({r["doc_id"] for r in out}) == clean
    tokens = defaultdict(int)
    for r in out:
        tokens[r["doc_id"]] += r["length"]
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in out)
    stages = dict(corpus_pipeline.STAGES)
    docs_ = spark.createDataFrame([(1, "a password=abcdefgh9 b", "en", "s", 22), (None, None, None, None, None)], TEXT)
    got = stages["secrets"](spark, docs_, source).collect()
    assert [(r["text"], r["n_chars"]) for r in got if r["doc_id"]] == [("a <assign> b", 12)] and not scan(b"a <assign> b")
    for name in ("quality", "near_dedup", "decontaminate", "secrets"):
        assert stages[name](spark, docs_.limit(0), source).columns == docs_.columns
