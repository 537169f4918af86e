"""The training-data operators against brute force, exact round trips and held-out accuracy, on small and awkward tables."""

import hashlib
import html
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, common, decontaminate, hashing, html_text, line_dedup, mixing, neighbours, ngram_join, sharding, toxicity, warc
from factloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
SEP = "\x20\x09\x0a\x0b\x0c\x0d"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], DOCS)


def words_of(text):
    for c in SEP[1:]:
        text = text.replace(c, " ")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ")


def shingle_set(text, k):
    w = [x for x in words_of(text or "") if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def awkward_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 20, 45]))) for _ in range(8)]
    out = [None, "", "   \n", "one", "one", "ONE", "two words", "É é x y", "a" * 30_000]
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(rng.choice([" ", "\t", "\n"]).join(w))
    return out


DENSE = {"dense_rows": 2, "block_rows": 5}


@pytest.mark.parametrize("k,num,den,options", [(4, 85, 100, {}), (5, 80, 100, DENSE), (3, 1, 1, {}), (2, 1, 2, DENSE)])
def test_jaccard_components(spark, k, num, den, options):
    rows = list(enumerate(awkward_texts(k))) + [(3, "a repeated id with another text"), (None, "one"), (None, None)]
    got = ngram_join.jaccard_components(docs_of(spark, rows).withColumn("n", F.lit(1)).withColumn("sig", F.lit("x")), k, num, den, **options)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got.collect()), key=repr) == brute_components(rows, k, num, den)


def test_jaccard_all_dense_group(spark):
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(docs_of(spark, rows), 4, 85, 100, dense_rows=8, block_rows=20).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=repr) == brute_components(rows, 4, 85, 100)


def rows_of_steps(monkeypatch):
    """Rows of each step that ngram_join writes, by label."""
    rows = {}

    def counted(df, label, f=common.materialise):
        out = f(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    return rows


def test_jaccard_chance_meetings_end_early(spark, monkeypatch):
    # renamed copies share few shingles: such pairs grow with the square of the copies
    rng, rows = random.Random(6), rows_of_steps(monkeypatch)
    base = [[f"{i}x{j}" for j in range(200)] for i in range(20)]
    texts = [(i, " ".join(w + rng.choice("$*&#%") for w in rng.choice(base))) for i in range(400)] + [(400, " ".join(base[0])), (401, " ".join([*base[0][:198], "a", "b"]))]
    got = ngram_join.jaccard_components(docs_of(spark, texts), 4, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: min(i, 400) for i, _ in texts} and rows["lists"] < 10


def test_jaccard_dense_groups_fall_apart(spark, monkeypatch):
    # texts of stock phrases share columns without being alike: their sets don't travel
    rng, rows = random.Random(7), rows_of_steps(monkeypatch)
    phrases = [" ".join(f"{i}p{j}" for j in range(40)) for i in range(30)]
    texts = [(i, " ".join(rng.sample(phrases, 4))) for i in range(120)]
    texts += [(i + 120, f"{t} end") for i, t in texts[:10]]
    got = ngram_join.jaccard_components(docs_of(spark, texts), 4, 85, 100, dense_rows=4, block_rows=20).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=repr) == brute_components(texts, 4, 85, 100)
    assert rows["dense-links"] and rows["sets"] < 60


def test_jaccard_empty_and_keep_one(spark):
    assert ngram_join.jaccard_components(docs_of(spark, []).limit(0)).count() == 0
    t = "a b c d e f g h i j"
    d = docs_of(spark, [(5, t), (2, t), (9, t + " "), (7, "other words in here now"), (8, None), (1, ""), (7, "other words in here now"), (None, t)])
    out = ngram_join.keep_one(d)
    assert out.columns == d.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([2, 7, 8, 1, None], key=repr)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, limit):
    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (8, 20), (None, 1), (5, 5)] + [(i, i + 1) for i in range(100, 115)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long"), max_task_links=limit).collect())
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 8} | dict.fromkeys(range(100, 116), 100)
    small = [e for e in edges if e[0] is not None and e[0] != e[1]]
    native = dict(tuple(r) for r in line_dedup.native_components(spark.createDataFrame(small, "a long, b long")).collect())
    assert native == got


def test_word_hashing_agrees_with_python():
    texts = awkward_texts(9) + ["x" * 3_000_000, None]
    for t, s in zip(texts, hashing.shingle_sets(texts, 4), strict=True):
        assert len(s) == len(shingle_set(t, 4))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    result = con.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())


def brute_leaks(rows, items, k, num, den):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", decontaminate.normalise(t))

    out = []
    for d, t in rows:
        w = words(t)
        for i, q in items:
            qw = words(q)
            n = min(k, len(qw))
            if n:
                want = {tuple(qw[x : x + n]) for x in range(len(qw) - n + 1)}
                have = {tuple(w[x : x + n]) for x in range(len(w) - n + 1)}
                if den * len(want & have) >= num * len(want):
                    out.append((d, i, len(want), len(want & have)))
    return sorted(out, key=repr)


def test_leaks(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 9, 30])))) for i in range(25)] + [(99, None), (98, "..."), (None, "v1 v2"), (7, "v3")]
    rows = [(0, None), (1, ""), (2, "short"), (None, items[3][1])]
    for i in range(3, 40):
        w = [rng.choice(vocab) for _ in range(rng.choice([2, 50, 4000]))]
        q = rng.choice(items[:25])[1].upper().replace(" ", ", ").split(" ")
        if rng.random() < 0.5:
            q[rng.randrange(len(q))] = "changed"
        at = rng.randrange(len(w))
        rows.append((i, " ".join(w[:at] + q + w[at:])))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items, 5, 80, 100)
    for chars in (decontaminate.BLOCK_CHARS, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = decontaminate.leaks(docs_of(spark, rows), b).collect()
        assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    hit = {w[0] for w in want if w[0] is not None}
    d = docs_of(spark, rows)
    left = decontaminate.remove(d, b)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - hit
    assert decontaminate.leaks(docs_of(spark, rows), b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>'
    '<header><div class="logo">Logo here</div><nav><ul><li><a href="/">Home</a><li><a href="/x">All of it</a></ul></nav></header>'
    '<div id="cookie-notice">We use cookies here and there, do you agree with all of them?</div>{main}'
    '<aside class="sidebar"><p>Something longer that stands beside the text but is none of it.</p></aside>'
    '<section class="comments"><h3>Comments</h3><p>I read all of this with interest, and I do not agree at all.</p></section>'
    '<form action="/s"><label>Search</label><input name=q><button>Go</button></form><footer>&copy; 2024 Someone, all rights reserved</footer></body></html>'
)


def test_main_text():
    article = '<article><h1>Head &amp; tail</h1><div class="ad">Buy this now</div><p>First&nbsp;&nbsp;part\n of <b>it</b>.<p>Two.<br>Lines</p><ul><li>an item<li><a href="q">linked</a> item</ul><p>&lt;tag&gt; 1 < 2</p></article>'
    want = "Head & tail\n\nFirst part of it.\n\nTwo. Lines\n\nan item\n\nlinked item\n\n<tag> 1 < 2"
    assert html_text.main_text(PAGE.format(main=article)) == want
    assert html_text.main_text(PAGE.format(main=article.replace("article", "main"))) == want
    for bare in (None, "", "<html></html>", "<script>x</script>", "<!-- open"):
        assert html_text.main_text(bare) == ""
    assert html_text.main_text("<article><p><b>A.<br><p>Be") == "A.\n\nBe"
    long = "word " * 50
    assert html_text.main_text(f"<div><a href=x>Home</a></div><div><p>{long}</p><p>{long}</p></div><div><a href=y>Next</a></div>") == "\n\n".join([long.strip()] * 2)


def test_tree_knows_its_table():
    x, y = html_text.training_table()
    assert len(y) < 200 and [html_text.is_main(html_text.tree(), list(f)) for f in x] == [bool(v) for v in y]


def test_extract_pages(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in Q.op3_html_text(spark, SF).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", p["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        text = "\n\n".join(b for b in parts if b)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (text, len(text))
    odd = spark.createDataFrame([(1, None, "u", "clash"), (1, None, "u", "clash"), (None, "", None, "x")], "page_id long, html string, url string, text string")
    out = html_text.extract(odd)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and [r["text"] for r in out.collect()] == ["", "", ""]
    assert html_text.extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize("s", ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|x", "<\\\\|", "[\\INST]", "<s><s>", "", "plain", "<<SYS>> <</SYS>>", "<|" * 50])
def test_escaping(s):
    e = chat.escape(s)
    assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)


def digest_rows(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns, loss, n = hashlib.sha256(), hashlib.sha256(), 0
        for _, _, role, text in mine:
            turns.update(f"{role or ''}\n{text or ''}\n".encode())
            if role == "assistant":
                loss.update((text or "").encode())
                n += len(text or "")
        out[conv] = (len(mine), turns.hexdigest(), n, loss.hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "<|end|> é 食料 [INST]"), (1, 1, "user", None), (1, 2, "assistant", "a\n\n b </s>"), (1, 3, "assistant", ""), (2, None, None, "x"), (2, 0, "assistant", "y" * 50_000), (None, 0, "user", "<|text|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("order_key", F.lit("clash"))
    formatted = chat.format_turns(df)
    tok = chat.Tokenizer(chat._ranks(chat.TOKENIZER))
    for r in formatted.collect():
        assert r["input_ids"][0] == tok.marks[chat.TURN] and r["input_ids"][-1] == tok.marks[chat.END]
        assert sum(x in tok.marks.values() for x in r["input_ids"]) == 3 and len(r["loss_mask"]) == len(r["input_ids"])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_turns(formatted)).collect()}
    assert got == digest_rows(rows)
    assert chat.digests(chat.read_turns(chat.format_turns(df.limit(0)))).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in Q.op4_chat_format(spark, SF).collect()}
    assert got == digest_rows(rows)


def test_hypergeometric():
    rng = np.random.default_rng(1)
    x = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert x.min() >= 0 and x.max() <= 20 and abs(x.mean() - 6) < 0.05 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert abs(sharding.hypergeometric(rng, 10**11, 10**11, 10**10) - 5 * 10**9) < 10**6
    before, sizes = np.array([0, 5, 5, 12, 13]), np.array([4, 4, 5])
    m = np.array([sharding.matrix_row(before, sizes, p, 3) for p in range(4)])
    assert m.sum(axis=0).tolist() == [4, 4, 5] and m.sum(axis=1).tolist() == [5, 0, 7, 1]
    cell = np.array([sharding.matrix_row(before, sizes, 2, s)[2] for s in range(5000)])
    assert abs(cell.mean() - 7 * 5 / 13) < 0.06 and abs(cell.var() - 7 * (5 / 13) * (8 / 13) * 6 / 12) < 0.06


def test_large_urns():
    columns = np.array([4 * 10**9, 10**9, 0, 5 * 10**9])
    x = sharding.split(np.random.default_rng(2), columns, 10**9)
    assert x.sum() == 10**9 and x[2] == 0 and np.abs(x - columns / 10).max() < 10**5


def test_shuffle_is_uniform(spark, tmp_path):
    """Every row is equally likely in every slot of every shard: chi-square over many seeds, and over pairs of neighbours."""
    spark.range(0, 12, 1, 3).write.parquet(str(tmp_path / "t"))
    d, place, together = spark.read.parquet(str(tmp_path / "t")), Counter(), 0
    for seed in range(60):
        at = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(d, 3, seed=seed, block_rows=2).collect()}
        assert sorted(at.values()) == [(s, i) for s in range(3) for i in range(4)]
        place.update(at.items())
        together += sum(at[i][0] == at[i + 1][0] for i in range(11))
    chi = sum((place[i, (s, j)] - 5) ** 2 / 5 for i in range(12) for s in range(3) for j in range(4))
    assert chi < 121 + 5 * np.sqrt(2 * 121) and abs(together / (60 * 11) - 3 / 11) < 0.08


@pytest.mark.parametrize("block_rows", [16_384, 7])
def test_shards(spark, tmp_path, block_rows):
    d = docs_of(spark, [(i % 90, None if i % 7 == 0 else f"text {i % 50}" * (1 if i else 300_000)) for i in range(203)]).withColumn("shard", F.lit("old")).withColumn("row", F.lit("r")).withColumn("_cell", F.lit("c")).withColumn("cell", F.lit(5))
    out = sharding.shard(d, 8, block_rows=block_rows)
    rows = out.collect()
    assert out.columns == [c for c in d.columns if c != "shard"] + ["shard", "slot"] and {(r["row"], r["_cell"], r["cell"]) for r in rows} == {("r", "c", 5)}
    assert Counter(r["shard"] for r in rows) == Counter({s: 26 if s < 3 else 25 for s in range(8)})
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in d.collect())
    assert sharding.shard(d.limit(0)).count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 203
    with pytest.raises(ValueError):
        sharding.shard(d, 0)


def test_shard_query(spark):
    rows = Q.op5_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert max(Counter(r["shard"] for r in rows).values()) - min(Counter(r["shard"] for r in rows).values()) <= 1 and {r["law"] for r in rows} == {"rows"}




def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def places_of(spark, d, path):
    d.write.mode("overwrite").parquet(path)
    d = spark.read.parquet(path)
    return d, common.materialise(line_dedup.lines(d), "test-lines")


def normal(line):
    import re

    return " ".join(re.findall(r"[^\W_]+", line.lower()))


@pytest.mark.parametrize("key_lines,share", [(8, 0.97), (2, 0.9)])
def test_line_groups_against_all_pairs(spark, monkeypatch, tmp_path, key_lines, share):
    """Against edit similarity alone: no line is grouped with one that no chain of similar lines leads to, and nearly all similar ones meet."""
    monkeypatch.setattr(line_dedup, "KEY_LINES", key_lines)
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 4, 12, 40]))] for _ in range(25)]
    lines = []
    for _ in range(160):
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(vocab)
        lines.append(rng.choice([" ", ", "]).join(w) + rng.choice(["", "!", "."]))
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, 160, 5)] + [None, "", "...\n\n", lines[0].upper()]
    d, found = places_of(spark, docs_of(spark, list(enumerate(texts)) + [(None, lines[1])]), str(tmp_path / "d"))
    norm = {}
    text_of = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in found.collect():
        norm[r["h"]] = normal(text_of[r["id"]].split("\n")[r["line_no"]])
    groups = {r["h"]: r for r in line_dedup.groups(d, found).collect()}
    assert set(groups) == set(norm)
    parent = {h: h for h in norm}

    def root(h):
        while parent[h] != h:
            h = parent[h]
        return h

    def similar(a, b):
        by_word = max(len(a), len(b)) > line_dedup.LONG_CHARS
        a, b = (a.split(), b.split()) if by_word else (a, b)
        most = int(max(len(a), len(b)) * 0.2 + 1e-9)
        return abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most

    pairs = [(a, b) for a in norm for b in norm if a < b and similar(norm[a], norm[b])]
    for a, b in pairs:
        parent[root(a)] = root(b)
    found_root = {h: (g["root_id"], g["root_line"]) for h, g in groups.items()}
    assert len(pairs) > 40 and np.mean([found_root[a] == found_root[b] for a, b in pairs]) >= share
    for h, g in groups.items():
        mine = [x for x in groups.values() if root(x["h"]) == root(h)]
        assert found_root[h] in {(x["first_id"], x["first_line"]) for x in mine}


def test_line_recall_on_documents(spark):
    """Of all pairs of distinct lines of the documents with edit similarity 0.8 or more, in characters, 0.95 or more are grouped."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = common.materialise(line_dedup.lines(d), "test-lines")
    roots = {r["h"]: (r["root_id"], r["root_line"]) for r in line_dedup.groups(d, found).collect()}
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    norm = {r["h"]: normal(text[r["id"]].split("\n")[r["line_no"]]) for r in found.collect()}
    rows = spark.createDataFrame([(h, t, len(t)) for h, t in norm.items()], "h long, t string, n int").repartition(8)
    rows.createOrReplaceTempView("all_lines")
    pairs = spark.sql("SELECT /*+ BROADCAST(y) */ x.h a, y.h b FROM all_lines x JOIN all_lines y ON x.h < y.h AND greatest(x.n, y.n) - least(x.n, y.n) <= floor(greatest(x.n, y.n) * 0.2 + 1e-9) WHERE levenshtein(x.t, y.t, cast(floor(greatest(x.n, y.n) * 0.2 + 1e-9) AS int)) >= 0").collect()
    assert len(pairs) > 30 and np.mean([roots[r["a"]] == roots[r["b"]] for r in pairs]) >= 0.95


def test_lines_at_edit_similarity_meet(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    pairs, least = [], {(1, 2): 1.0, (8, 19): 0.97, (20, 49): 0.97, (60, 90): 0.97}
    for (low, high) in least:
        for _ in range(60):
            w = [rng.choice(vocab) for _ in range(rng.randint(low, high))]
            a, changed = " ".join(w), list(w)
            if high <= 2:
                a = a[:14]
                at = rng.randrange(len(a))
                b = line_dedup_edit(a, at)
            else:
                changed[rng.randrange(len(w))] = rng.choice(vocab)
                b = " ".join(changed)
            if a != b and levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                pairs.append(((low, high), a, b))
    d, found = places_of(spark, docs_of(spark, [(i, x) for i, x in enumerate(x for _, a, b in pairs for x in (a, b))]), str(tmp_path / "d"))
    root = {(r["first_id"]): r["root_id"] for r in line_dedup.groups(d, found).collect()}
    first = {}
    for i, x in enumerate(x for _, a, b in pairs for x in (a, b)):
        first.setdefault(x, i)
    for size, wanted in least.items():
        together = [root[first[a]] == root[first[b]] for s, a, b in pairs if s == size]
        assert len(together) > 20 and np.mean(together) >= wanted


def test_lines_under_crowded_sets_all_meet(spark, tmp_path):
    """Pairs that share only keys of many lines, and are like no other line."""
    rng = random.Random(3)
    begin, lines = [f"c{i}" for i in range(28)], []
    for g in range(30):
        tail = [f"t{g}x{i}" for i in range(12)]
        changed = [f"v{g}x{i}" if i in (2, 5, 8, 11) else w for i, w in enumerate(tail)]
        lines += [" ".join(begin + tail), " ".join(begin + changed)]
    rng.shuffle(lines)
    d, found = places_of(spark, docs_of(spark, list(enumerate(lines))), str(tmp_path / "d"))
    root = {r["first_id"]: r["root_id"] for r in line_dedup.groups(d, found).collect()}
    of = defaultdict(list)
    for i, line in enumerate(lines):
        of[line.split()[28].split("x")[0]].append(root[i])
    assert np.mean([a == b for a, b in of.values()]) >= 0.9 and len({a for a, _ in of.values()}) == 30


def test_lines_that_share_few_crowded_keys_meet(spark, tmp_path):
    """Pairs that share two of eight keys or one of four, which all lines have."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(10))
    phrase, lines, pairs = [f"phrase{i}word" for i in range(5)], [], []
    for i in range(30):
        few = i % 2
        w = phrase[: 5 - few] + [word() for _ in range(3 if few else 6)]
        lines += [" ".join(w), " ".join(f"z{x[1:]}" if k in ((4,) if few else (5, 8)) else x for k, x in enumerate(w))]
        pairs.append((2 * i, 2 * i + 1))
    d, found = places_of(spark, docs_of(spark, list(enumerate(lines))), str(tmp_path / "d"))
    keys = {r["id"]: set(r["keys"]) for r in found.collect()}
    of = Counter(k for x in keys.values() for k in x)
    assert all(len(keys[a] & keys[b]) == 2 - i % 2 and all(of[k] >= 30 for k in keys[a] & keys[b]) for i, (a, b) in enumerate(pairs))
    root = {r["first_id"]: r["root_id"] for r in line_dedup.groups(d, found).collect()}
    assert all(root[a] == root[b] == a for a, b in pairs)


def test_lines_of_a_long_common_passage_meet_by_words(spark, monkeypatch, tmp_path):
    """Under pairs of words that many lines share, lines meet by their rarest words: similar ones are found, not all held together."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 16)
    rng = random.Random(5)
    passage, lines = [f"c{i}word" for i in range(36)], []
    for g in range(60):
        own = [f"t{g}word{i}" for i in range(18)]
        lines += [" ".join(own + passage)] + [" ".join([f"v{g}word{i}" if i in (2, 6, 10, 14) else w for i, w in enumerate(own)] + passage)] * (g < 20)
    rng.shuffle(lines)
    d, found = places_of(spark, docs_of(spark, list(enumerate(lines))), str(tmp_path / "d"))
    made, write = Counter(), line_dedup.materialise

    def counted(df, label):
        out = write(df, label)
        made[label] += out.count()
        if label == "dense-words":
            made["meet"] += sum(r["count"] * (r["count"] - 1) // 2 for r in out.groupBy("key").count().collect())
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    root = {r["first_id"]: r["root_id"] for r in line_dedup.groups(d, found).collect()}
    of = defaultdict(set)
    for i, line in enumerate(lines):
        of[line.split()[0].split("w")[0]].add(root[i])
    assert len(of) == 60 and len(set().union(*of.values())) == 60 and all(len(x) == 1 for x in of.values())
    assert made["dense-words"] > 0 and made["meet"] < 1000


def test_lines_of_a_common_passage_do_not_all_meet(spark, monkeypatch, tmp_path):
    """Lines that are half a passage which all share: similar ones are found, without a pair for every two lines."""
    rng = random.Random(5)
    passage, lines = [f"c{i}word" for i in range(30)], []
    for g in range(70):
        own = [f"t{g}word{i}" for i in range(30)]
        changed = [f"v{g}word{i}" if i in (4, 11, 18, 25) else w for i, w in enumerate(own)]
        lines += [" ".join(own + passage)] + [" ".join(changed + passage)] * (g < 20)
    rng.shuffle(lines)
    d, found = places_of(spark, docs_of(spark, list(enumerate(lines))), str(tmp_path / "d"))
    made, write = Counter(), line_dedup.materialise

    def counted(df, label):
        out = write(df, label)
        made[label] += out.count()
        if label == "dense-rarest":
            made["meet"] += sum(r["count"] * (r["count"] - 1) // 2 for r in out.groupBy("key").count().collect())
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    root = {r["first_id"]: r["root_id"] for r in line_dedup.groups(d, found).collect()}
    of = defaultdict(set)
    for i, line in enumerate(lines):
        of[line.split()[0].replace("v", "t")].add(root[i])
    assert len(of) == 70 and len(set().union(*of.values())) == 70 and all(len(x) == 1 for x in of.values())
    # all pairs of 90 lines are 4005
    assert made["dense-lines"] > 0 and made["near-pairs"] + made["lines-apart"] < 2000 and made["meet"] < 2000


def test_short_lines_that_repeat_characters_do_not_all_meet(spark, monkeypatch, tmp_path):
    """A repeated run of characters takes one place among the keys: such lines have all keys, and need more than one that they share."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    often, lines = [word(5) for _ in range(4)], []
    for i in range(80):
        line = f" {often[i % 4]} ".join(word(7) for _ in range(4))
        lines += [line, line_dedup_edit(line, rng.randrange(len(line)))]
    lines += [w[:8] for w in (word(9) for _ in range(40))]
    d, found = places_of(spark, docs_of(spark, list(enumerate(lines))), str(tmp_path / "d"))
    keys = {r["id"]: r["keys"] for r in found.collect()}
    assert all(len(set(keys[i])) == line_dedup.KEYS for i in range(160))
    # lines too short for a longer partner of the other kind have deletions only
    assert all(k % 2 for i in range(160, 200) for k in keys[i])
    made, write = Counter(), line_dedup.materialise

    def counted(df, label):
        out = write(df, label)
        made[label] += out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    root = {r["first_id"]: r["root_id"] for r in line_dedup.groups(d, found).collect()}
    assert made["single-keys"] == 0
    assert np.mean([root[i] == root[i + 1] == i for i in range(0, 160, 2)]) >= 0.97 and len({root[i] for i in range(160)}) <= 82


def line_dedup_edit(a, at):
    return a[:at] + "z" + a[at + 1 :]


def test_line_dedup_rows(spark):
    d = docs_of(spark, [(2, "same line here\nown"), (1, "Same  line, here!\n\nlast"), (3, None), (4, ""), (5, "...\n..."), (1, "Same  line, here!\n\nlast"), (None, "own")]).withColumn("row", F.lit("clash")).withColumn("h", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_lines"], r["n_kept"], r["dropped_lines"], r["text_out"]) for r in line_dedup.dedup(d).collect()), key=repr)
    twice = (1, 3, 3, [], "Same  line, here!\n\nlast")
    assert got == sorted([twice, twice, (2, 2, 1, [0], "own"), (3, 0, 0, [], None), (4, 1, 1, [], ""), (5, 2, 2, [], "...\n..."), (None, 1, 0, [0], "")], key=repr)
    assert line_dedup.dedup(d.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    two = line_dedup.dedup(docs_of(spark, [(1, long), (2, "x\n" + long + " end")])).collect()
    assert {r["doc_id"]: r["dropped_lines"] for r in two} == {1: [], 2: [1]}


def test_exponents():
    tokens = [900.0, 90.0, 10.0, 0.0]
    assert mixing.find_exponent(tokens) == 1.0
    a = mixing.find_exponent(tokens, repetition_limit=3.0)
    assert mixing.repetition(tokens, mixing.weights(tokens, a)) == pytest.approx(3.0)
    e = mixing.find_exponent(tokens, target_entropy=0.9)
    assert mixing.entropy(mixing.weights(tokens, e)) == pytest.approx(0.9)
    assert mixing.find_exponent(tokens, target_entropy=9.0) == 0.0 and mixing.find_exponent(tokens, target_entropy=0.0) == 1.0
    assert mixing.find_exponent(tokens, target_entropy=9.0, repetition_limit=3.0) == pytest.approx(a)
    assert mixing.weights([0.0, 0.0], 0.5) == [0.0, 0.0]


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 9)), "en", "big" if i % 3 else ("mid" if i % 2 else None), 1) for i in range(600)] + [(900, "", "en", "empty", 0), (901, None, "en", "empty", 0), (5, "again", "en", "big", 1)]
    d = spark.createDataFrame(rows, DOCS).withColumn("epoch", F.lit("old")).withColumn("_mix_k", F.lit("old")).withColumn("_k", F.lit("old"))
    kept = mixing.mix(d, annotate=False, repetition_limit=2.5)
    assert kept.columns == d.columns and {(r["epoch"], r["_mix_k"], r["_k"]) for r in kept.collect()} == {("old", "old", "old")}
    plan = {p[0]: p for p in mixing.plan(d, repetition_limit=2.5)}
    assert min(p[3] for p in plan.values()) == 1.0 and max(p[3] for p in plan.values()) == pytest.approx(2.5)
    out = mixing.mix(d, repetition_limit=2.5).collect()
    longest = 8
    for source, (_, tokens, weight, epochs, _) in plan.items():
        mine = [r for r in out if r["source"] == source]
        got = sum(len((r["text"] or "").split()) for r in mine)
        assert abs(got - tokens * epochs) <= longest
        own = Counter((r[0], r[1]) for r in rows if r[3] == source)
        for e in range(int(epochs)):
            assert Counter((r["doc_id"], r["text"]) for r in mine if r["epoch"] == e) == own
        assert all(c <= own[k] for k, c in Counter((r["doc_id"], r["text"]) for r in mine if r["epoch"] == int(epochs)).items())
        assert {r["mix_weight"] for r in mine} == {weight}
    assert mixing.mix(d.limit(0), repetition_limit=2.0).count() == 0
    budget = mixing.mix(d, budget_tokens=300).collect()
    assert abs(sum(len((r["text"] or "").split()) for r in budget) - 300) <= 3 * longest


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in Q.op8_toxicity(spark, sf).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    right = [rows[r["doc_id"]]["predicted"] == r["toxic"] for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(right) / len(right) > 0.9


def test_toxicity_edges(spark):
    texts = [(i, f"a kind word number {i}" + " idiot" * (i % 3 == 0)) for i in range(190)] + [(200, None), (201, ""), (None, "idiot"), (202, "IDIOT " * 5000)]
    d = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    y = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(190)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.train(d, y)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, m, ["doc_id"]).collect()}
    assert got[202] > 0.5 and got[None] > 0.5 and got[200] == got[201] < 0.5 and got[4] < 0.5
    left = toxicity.reject(d, m)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {i for i, s in got.items() if s < 0.5}
    for labels in (y.limit(0), y.where("toxic = 0"), y.where("toxic = 1")):
        constant = {r["score"] for r in toxicity.score(d, toxicity.train(d, labels), ["doc_id"]).collect()}
        assert len(constant) == 1 and 0 <= constant.pop() <= 1
    assert toxicity.score(d.limit(0), m, ["doc_id"]).count() == 0


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        a = np.array(v, np.float64)
        scored = sorted((-float(a @ np.array(w, np.float64)) / float(np.linalg.norm(a) * np.linalg.norm(np.array(w, np.float64))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = scored[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)] + [(2000, [1.0, 0.0]), (2050, [0.5, 0.1])]
    bad = [(3000, None), (3050, [0.0] * 8), (3100, [float("nan")] * 8), (3150, [None] + [1.0] * 7), (3200, []), (None, [1.0] * 8), (3250, [float("inf")] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5, shard_rows=90, leaf_rows=7).collect()
    want = brute_nearest(rows, [(i, v) for i, v in rows if i % 50 == 0], 5)
    assert {r["query_id"] for r in got} == set(want)
    for q, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == [i for _, i in near] and [m[2] for m in mine] == pytest.approx([-s for s, _ in near])
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, F.lit(True), relax=0.5)


@pytest.mark.parametrize("shard_rows,leaf_rows", [(16_384, 1024), (300, 16)])
def test_neighbours_ties(spark, shard_rows, leaf_rows):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(6)
    scaled = [base * 2.0 ** int(e) for e in rng.permutation(40)]
    quantised = list(rng.integers(-1, 2, (500, 6)).astype(float))
    rows = [(i, v) for i, v in enumerate(scaled + quantised + list(rng.standard_normal((400, 6)))) if v.any()]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 5, shard_rows=shard_rows, leaf_rows=leaf_rows).collect()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q, v in rows:
        if q % 20 == 0:
            score = neighbours.cosines(np.broadcast_to(v, x.shape), x)
            want = [int(i) for i in ids[np.lexsort((ids, -score))] if i != q][:5]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_relaxed_recall():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    unit = neighbours._units(centres[rng.integers(40, size=4000)] + 0.3 * rng.standard_normal((4000, 16)))
    tree, q = neighbours.Tree(unit, 64), np.arange(0, 4000, 50)
    exact = np.argsort(-(unit[q] @ unit.T), axis=1)[:, 1:6]
    for relax, least in ((1.0, 1.0), (1.3, 0.9)):
        found = tree.search(unit[q], q, np.arange(4000), 5, relax)
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact.tolist(), found.tolist(), strict=True)]) >= least


def brute_warc(rows):
    least = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= warc.REVISIT_FROM:
            key = (i is None, i or 0)
            least[b] = min(least.get(b, key), key)
    out, given = [], set()
    for i, h in rows:
        b = (h or "").encode()
        first = least.get(b)
        response = first is None or (first == (i is None, i or 0) and b not in given)
        if response and first is not None:
            given.add(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if response else "revisit", None if response else (None if first[0] else first[1])))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 120_000
    pages = [(5, "x" * 100), (3, "x" * 100), (9, "x" * 100), (4, "y" * 99), (2, "y" * 99), (1, None), (7, ""), (8, big), (6, big), (None, "z" * 200), (None, "z" * 200), (11, "q" * 300), (11, "q" * 300)]
    df = spark.createDataFrame([(i, h, f"http://x/{i}\r\nEvil: 1") for i, h in pages], "page_id long, html string, url string").withColumn("digest", F.lit("clash"))
    table = warc.write(df)
    assert table.where("n_chunks > 1").count() > 3 and table.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK_BYTES + 1000
    for r in table.groupBy("record").agg(F.count("*").alias("c"), F.min("n_chunks").alias("a"), F.max("n_chunks").alias("b"), F.max("chunk").alias("m")).collect():
        assert r["c"] == r["a"] == r["b"] == r["m"] + 1
    assert sorted((tuple(r) for r in warc.read(table).collect()), key=repr) == brute_warc(pages)
    warc.export(table, str(tmp_path / "warc"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("*.warc")))
    assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID: ") == len(pages) and b"Evil" in data and b"\nEvil" not in data
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_warc_long_url(spark):
    df = spark.createDataFrame([(1, "a" * 500, "http://x/" + "u" * 2_000_000), (2, "é" * 700_000, None)], "page_id long, html string, url string")
    got = warc.read(warc.write(df)).collect()
    assert sorted(tuple(r) for r in got) == brute_warc([(1, "a" * 500), (2, "é" * 700_000)])


def test_warc_damage(spark):
    table = warc.write(spark.createDataFrame([(1, "a" * 500, "u")], "page_id long, html string, url string"))
    broken = table.withColumn("data", F.expr("cast(replace(cast(data as string), 'aaaa', 'aaab') as binary)"))
    with pytest.raises(Exception, match="damaged"):
        warc.read(broken).collect()
    short = table.withColumn("data", F.expr("substring(data, 1, length(data) - 50)"))
    with pytest.raises(Exception, match="breaks off"):
        warc.read(short).collect()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    now, kept = docs, []
    for i, (name, stage) in enumerate(P.STAGES):
        before = now
        now = common.materialise(stage(spark, before, SF), f"test-{name}")
        if i < 4:
            assert now.dtypes == docs.dtypes
        a, b = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, now))
        assert b.items() <= a.items()
        kept.append((a, b))
        if name == "ngram_jaccard":
            groups = brute_components(list(a.items()), 5, 80, 100)
            assert sorted(b) == sorted({g[2] for g in groups if g[1]} | {g[0] for g in groups if not g[1]})
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(a) - set(b) == {x[0] for x in brute_leaks(list(a.items()), items, 5, 80, 100)}
        if name in ("mixing", "sharding"):
            assert a == b
    assert P.run(spark, SF).count() == now.count()
