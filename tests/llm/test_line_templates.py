import random
import re

import duckdb
import pytest

from failcast.llm import line_templates as T
from tests.conftest import SF001, SF01


def brute(rows, depth=4, min_docs=5, constant=0.6, most=8 / 9):
    """(id, text) rows -> sorted (id, text, n_lines, n_dropped)."""
    def tokens(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    texts = sorted({(i, t) for i, t in rows if t is not None}, key=str)
    lines = [(i, t, at, tokens(x)) for i, t in texts for at, x in enumerate(t.split("\n")) if tokens(x)]
    holders, support, template, docs = {}, {}, {}, {}
    for i, _, _, k in lines:
        holders.setdefault(k, set()).add(i)
    for k, ids in holders.items():
        for p, w in enumerate(k):
            key = (len(k), k[:depth], p, w)
            support[key] = support.get(key, 0) + len(ids)
    for k in holders:
        fixed = tuple((p, w) for p, w in enumerate(k) if w != "<*>" and support[(len(k), k[:depth], p, w)] >= min_docs)
        if fixed and len(fixed) >= constant * sum(w != "<*>" for w in k):
            template[k] = (len(k), k[:depth], fixed)
    for i, _, _, k in lines:
        if k in template and i is not None:
            docs.setdefault(template[k], set()).add(i)
    out = []
    for i, t in rows:
        own = [] if t is None else [(at, tokens(x)) for at, x in enumerate(t.split("\n")) if tokens(x)]
        drop = {at for at, k in own if k in template and len(docs.get(template[k], ())) >= min_docs}
        if sum(len(k) for at, k in own if at in drop) > most * sum(len(k) for _, k in own):
            drop = set()
        kept = None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in drop)
        out.append((i, kept, len(own), len(drop)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return sorted((tuple(r) for r in T.cleaned(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "é", "日本", "C", "x"]
    forms = ["Copyright {} by some holder", "click here to read page {} of {}", "  shared   footer line for all\t", "user {} logged in from {}", "one two three"]
    rows = []
    for i in range(120):
        ls = [" ".join(rng.choices(words + [f"w{j}" for j in range(9)], k=rng.randint(0, 14))) for _ in range(rng.randint(0, 5))]
        for f in forms:
            if rng.random() < 0.25:
                ls.insert(rng.randint(0, len(ls)), f.format(rng.choice(["7", "Ann", "Bob", "q12", "Eve"]), rng.choice(["8", "home", "x.y", "net"])))
        rows.append((i, "\n".join(ls)))
    rows += [(None, rows[3][1]), (None, None), (130, None), (131, ""), (132, "\n\n"), rows[4], rows[4], (4, "shared footer line for all\nbut more words than that line has here"), (-5, "k " * 30000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 40
    assert run(spark, rows, min_docs=2, depth=1, most_share=1.0) == brute(rows, 1, 2, 0.6, 1.0)


def test_copies_stay_whole(spark):
    text = "\n".join(f"line number {w} of a copied text" for w in "abcdefgh")
    rows = [(i, text) for i in range(20)]
    assert run(spark, rows) == sorted(((i, text, 8, 0) for i in range(20)), key=str)


def test_short_and_masked_lines_and_heavy_banners(spark):
    """Expected texts written by hand: a short footer, a line of variable fields, and a banner longer than the page's own words."""
    banner = "this banner of ten plain words heads every single page"
    own = ["alpha beta gamma", "delta eps zeta", "eta theta iota", "kappa lambda mu", "nu xi omicron", "pi rho sigma"]
    rows = [(i, f"{banner}\n{o}\nAll rights reserved.\nPage {i} of 9") for i, o in enumerate(own)]
    rows += [(i, f"{i}{i} 7\nsome words that stand in document {c} alone {c}") for i, c in zip(range(10, 16), "abcdef")]
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert [got[i] for i in range(6)] == [(o, 4, 3) for o in own]
    # numbers alone have no constant token and stay; the line below them is one template with two fields
    assert [got[i] for i in range(10, 16)] == [(f"{i}{i} 7", 2, 1) for i in range(10, 16)]


def test_rows_of_one_text(spark):
    """Repeated rows count a place once, so they lose what a single row loses."""
    footer = "one footer line that every document ends with"
    rows = [(i, f"only document {c} has this very line {c}{c}\n{footer}") for i, c in enumerate("pqrstu")] + [(0, f"only document p has this very line pp\n{footer}")] * 3
    assert run(spark, rows) == brute(rows)


def test_other_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "keep this one here please friend\nsame footer in every doc " + "x" * i, 3, "t") for i in range(8)], "doc_id long, text string, at int, drop string")
    assert T.without_repeated_lines(docs).columns == docs.columns
    assert T.without_repeated_lines(docs.limit(0)).collect() == [] and T.cleaned(docs.limit(0)).collect() == []


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_matches_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = sorted(con.execute(T.cleaned_sql()).fetchall(), key=str)
    assert sorted((tuple(r) for r in T.cleaned(spark.read.parquet(f"{folder}/documents.parquet")).collect()), key=str) == want


def test_only_native_plan(spark):
    plan = T.cleaned(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
