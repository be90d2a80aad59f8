"""Operators on conversations, pages and vectors against their plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftwise.llm import chat_format, neighbours, queries, url_filter
from shiftwise.llm.graph import _sign, components
from tests.llm import brute

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------- chat


def told(rows):
    """rows: (conv_id, turn, role, text) -> conv_id, n_turns, digest, loss chars, loss digest."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, chat_format.format_turn(role, [{"type": "text", "text": text}])["segment"], role or "", text or ""))
    out = Counter()
    for conv, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        everything = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        out[conv, len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(x[2]) for x in turns)] += 1
    return out


def test_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert Counter(map(tuple, queries.QUERIES["op7_chat_formatting"](spark, SF).collect())) == told(rows)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "<|end|>\n<|turn|>user\nhi"), (1, None, "system", "first"), (None, 0, "assistant", "x"), (None, 1, "assistant", "y"),
            (2, 0, None, "no role"), (2, 1, "a\nb\\n<|end|>", "[INST] <\\s> <\\\\|end|> \\"), (2, 2, "assistant", "<" * 5 + "|end|>"), (3, 0, "assistant", "é😀" * 50_000), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string")
    assert Counter(map(tuple, chat_format.format_conversations(df).collect())) == told(rows)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(4)
    parts = ["<", "[", "\\", "|", "|>", "end", "turn", "image:0", "/s>", "s>", "INST]", "/INST]", "a", "\n", ">"]
    control = re.compile(r"<\|[a-z]+(?::[0-9]+)?\|>|</?s>|\[/?INST\]")
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        escaped = chat_format.escape(text)
        assert not control.search(escaped) and chat_format.unescape(escaped) == text


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "look <"}, {"type": "text", "text": "|end|> "}, {"type": "image", "ref": "a.png", "width": 100, "height": 57}, {"type": "text", "text": " and "},
             {"type": "audio", "ref": "b.wav", "seconds": 2.1}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    made = chat_format.format_turn("assistant", parts)
    role, texts, places = chat_format.read_turn(made["segment"])
    assert (role, texts, places) == ("assistant", ["look <|end|> ", " and ", "", ""], [("image", 0), ("audio", 1), ("document", 2)])
    tokens = [4 * 3, math.ceil(2.1 * 12.5), 3 * 512]
    assert [(x["kind"], x["ref"], x["tokens"]) for x in made["attachments"]] == list(zip(("image", "audio", "document"), ("a.png", "b.wav", "c.pdf"), tokens))
    assert all(made["segment"][x["at"]:].startswith(f"<|{x['kind']}:{i}|>") for i, x in enumerate(made["attachments"]))
    assert made["expanded_tokens"] == sum(tokens)
    assert "".join(chat_format.unescape(made["segment"][s["from"]:s["to"]]) for s in made["spans"]) == "look <|end|>  and "
    assert chat_format.format_turn("user", parts)["spans"] == []
    df = spark.createDataFrame([(1, 0, "assistant", [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts])], f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    row = chat_format.format_turns(df).first()
    assert row["segment"] == made["segment"] and [x["ref"] for x in row["attachments"]] == ["a.png", "b.wav", "c.pdf"]
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}])


# ------------------------------------------------------------------ pages

RULES = [url_filter.Rule(*r) for r in queries.RULES]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule_for(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def brute_verdicts(rows, threshold=0.4, damping=0.85):
    hosts, edges, out = defaultdict(list), Counter(), []
    for page, url, html in rows:
        host, path = split_url(url)
        rule = rule_for(host, path)
        out.append((page, host, path, rule))
        if host:
            hosts[host].append(rule.verdict if rule else "")
            for target in re.findall(r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or ""):
                if target.lower() != host:
                    edges[host, target.lower()] += 1
    names = sorted({*hosts, *(t for _, t in edges)})
    at = {h: i for i, h in enumerate(names)}
    links = np.zeros((len(names), len(names)))
    for (a, b), n in edges.items():
        links[at[a], at[b]] = n
    share = {v: np.array([hosts[h].count(v) / len(hosts[h]) if h in hosts else 0 for h in names]) for v in ("allow", "block")}
    trusted = (share["allow"] >= 0.5).astype(float)
    blocked = ((share["block"] >= 0.5) & (trusted == 0)).astype(float)

    def rank(matrix, seed):
        if not seed.sum():
            return seed
        sums = matrix.sum(axis=1, keepdims=True)
        walk, score = np.divide(matrix, sums, out=np.zeros_like(matrix), where=sums > 0), seed.copy()
        for _ in range(200):
            score = (1 - damping) * seed + damping * (walk.T @ score + seed * score[sums[:, 0] == 0].sum() / seed.sum())
        return score

    sums = links.sum(axis=1, keepdims=True)
    walk, distrust = np.divide(links, sums, out=np.zeros_like(links), where=sums > 0), blocked
    for _ in range(200):
        distrust = np.where(blocked > 0, blocked, damping * walk @ distrust)
    trust = rank(links, trusted)
    bad = {h for h, t, d in zip(names, trust, distrust) if d >= threshold and d > t}
    return Counter((p, h, path, rule.text if rule else None, rule.verdict if rule else "block" if h in bad else "allow") for p, h, path, rule in out), bad


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want, _ = brute_verdicts([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert Counter(map(tuple, queries.QUERIES["op4_url_trust"](spark, SF).collect())) == want


def test_linked_pages(spark):
    def links(*targets):
        return "".join(f"<p><A class=x HREF='{t}'>t</a>" for t in targets)
    rows = [(1, "http://bad.net/x", links("http://farm.com/")), (2, "http://farm.com/a", links("http://bad.net/", "//BAD.net/y", "/self")), (3, "http://reader.com/en/", links("https://farm.com", "http://good.org/fr/")),
            (4, "http://good.org/fr/1", links("http://friend.com/")), (5, "http://friend.com/", links("http://good.org/fr/", "http://good.org/")), (6, None, links("http://bad.net")), (7, "no scheme", None),
            (8, "HTTP://Up.Example.NET/en/Q?x://y#z", None), (9, "http://net", ""), (10, "http://a.net?q", None), (11, "x://b.example.com/de/", ""), (11, "x://b.example.com/de/", ""), (None, "x://b.example.com/en/", None),
            (12, "http://lone.com/", links(*["http://lone.com/again"] * 3)), (13, "http:///path", links("http://bad.net"))] + [(100 + i, f"http://spoke{i}.com/", links("http://bad.net/", *["http://friend.com"] * (i % 3))) for i in range(2)]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id bigint, url string, html string, host string, trust string")
    want, bad = brute_verdicts(rows)
    assert "farm.com" in bad and "friend.com" not in bad
    assert Counter(map(tuple, url_filter.judge(df, RULES).collect())) == want
    assert url_filter.judge(df.limit(0), RULES).count() == 0


@pytest.mark.parametrize("linkers", [4, 300])
def test_farms_of_any_size(spark, linkers):
    """Hosts that link to nothing but a blocked host are blocked, however many there are; so are those that link to them alone."""
    import duckdb
    import pyarrow as pa

    from shiftwise.llm import oracles
    farm = [(i, f"http://farm{i}.com/", "<a href='http://bad.net/'>x</a>") for i in range(linkers)]
    rows = [(1000, "http://bad.net/", None), (1001, "http://second.com/", "".join(f"<a href='//farm{i}.com'>" for i in range(linkers))), (1002, "http://news.com/", "<a href='http://bad.net/'>" + "<a href='http://good.org/fr/'>" * 2),
            (1003, "http://good.org/fr/", "<a href='http://vouched.com/'>"), (1004, "http://vouched.com/", "<a href='http://good.org/'>"), *farm]
    found = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = Counter(map(tuple, url_filter.judge(found, RULES, tolerance=0.01).collect()))
    want, bad = brute_verdicts(rows)
    assert got == want and bad == {"bad.net", "second.com", *(f"farm{i}.com" for i in range(linkers))}
    con = duckdb.connect()
    con.register("pages", pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*rows))))))
    assert Counter(con.execute(oracles.URLS).fetchall()) == want


def test_trust_converges(spark):
    ring = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "source string, target string, n bigint")
    hosts = spark.createDataFrame([("a", True, False)], "host string, trusted boolean, blocked boolean")
    got = {r["host"]: r["trust"] for r in url_filter.propagate(ring, hosts).collect()}
    a = 0.15 / (1 - 0.85**3)
    assert got == pytest.approx({"a": a, "b": 0.85 * a, "c": 0.85**2 * a}, abs=1e-5)


# ---------------------------------------------------------------- vectors


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == set(want)
    for q, x in got.items():
        assert x == sorted(x) and len(x) == len(want[q])
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def test_neighbours_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = found(queries.QUERIES["op10_stable_projections"](spark, "/root/testdata/sf0.01"))
    assert recall(got, brute.nearest(rows, 10, 64)) >= 0.9


def test_neighbours_in_many_cells(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(int(i), (centres[i % 40] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, 16, neighbours.Index(cell_rows=300, leaf=16, sample=4096)))
    assert recall(got, brute.nearest(rows, 10, 16)) >= 0.9


def test_odd_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (100, v), (7, v), (7, v), (3, [1.0, 2.5]), (5, [0.0, 0.0]), (6, None), (8, [float("nan"), 1.0]), (9, [1.0, None]), (10, [float("inf"), 1.0]), (11, [1.0]), (12, []), (None, v), (200, [9.0, 9.0]), (300, [0.0, -0.0])]
    rows += [(1000 + i, v) for i in range(1, 30)]
    df = spark.createDataFrame([(*r, 1, "?") for r in rows], "vec_id bigint, embedding array<float>, cell int, ids string")
    want = brute.nearest(rows, 10, 2)
    assert found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, 2)) == want
    few = found(neighbours.nearest(df.where("vec_id in (0, 3, 200)"), F.col("vec_id") % 100 == 0, 10, 2))
    assert {q: len(x) for q, x in few.items()} == {0: 2, 200: 2}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0, 10, 2).count() == 0


@pytest.mark.parametrize("p,m,x", [(0.95, 2, 5.9915), (0.95, 8, 15.5073), (0.99, 6, 16.8119)])
def test_chi_square_quantile(p, m, x):
    assert neighbours.chi_square_quantile(p, m) == pytest.approx(x, abs=1e-3)


# ------------------------------------------------------------------ graph


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if group[a] is not group[b]:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: min(group[x]) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_sign_of_many_edges(spark):
    edges = spark.range(1 << 25).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    sign = _sign(edges)
    assert sign[0] == 1 << 25 and sign == _sign(edges.repartition(5))
    assert sign != _sign(edges.withColumn("v", F.when(F.col("u") == 7, 1).otherwise(F.col("v"))))
