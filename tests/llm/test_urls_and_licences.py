"""URL filter and licence scan against plain versions."""

import collections
import hashlib
import math
import re

import duckdb

from companion.llm import licence_scan, queries, url_filter


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def plain_templates(rows):
    """(host, forms) -> (template, purity); rows are (host, path, label or None)."""
    form = {}
    for host, path, _ in rows:
        hexed = re.sub(r"(?<![0-9A-Za-z])[0-9a-fA-F]{16,}(?![0-9A-Za-z])", "{h}", path)
        steps = re.sub("[0-9]+", "{n}", hexed).split("/")
        form[host, path] = tuple(steps[:url_filter.DEPTH] + ["**"] * (len(steps) > url_filter.DEPTH))
    named = {(h, f): f for (h, _), f in form.items()}
    # from the root down: a level is decided when all above it are
    for depth in range(url_filter.DEPTH + 1):
        children = collections.defaultdict(collections.Counter)
        for host, path, _ in rows:
            t = named[host, form[host, path]]
            if len(t) > depth:
                children[host, t[:depth]][t[depth]] += 1
        for (host, f), t in named.items():
            node = children[host, t[:depth]]
            if (len(t) > depth and len(node) >= url_filter.MANY_CHILDREN
                    and node[t[depth]] < url_filter.SMALL_SHARE * sum(node.values())):
                named[host, f] = t[:depth] + ("*",) + t[depth + 1:]
    def family(t):
        literal = [i for i, s in enumerate(t) if s and "{" not in s and s != "*"]
        return t if not literal else t[:literal[-1]] + ("+",) + t[literal[-1] + 1:]
    n, b, node_n, node_b = (collections.Counter() for _ in range(4))
    for host, path, label in rows:
        if label is not None:
            t = named[host, form[host, path]]
            n[host, t] += 1
            b[host, t] += label
            for d in range(1, len(t) + 1):
                node_n[host, t[:d]] += 1
                node_b[host, t[:d]] += label
    fn, fb = collections.Counter(), collections.Counter()
    for (host, t), k in n.items():
        if k >= url_filter.MIN_LABELLED:
            fn[host, family(t)] += k
            fb[host, family(t)] += b[host, t]
    alike = collections.defaultdict(list)
    for (host, t), k in n.items():
        key = host, family(t)
        if k >= url_filter.MIN_LABELLED:
            p = fb[key] / fn[key]
            if abs(b[host, t] - k * p) <= url_filter.Z * math.sqrt(k * p * (1 - p)):
                alike[key].append(t)
    a = url_filter.SMOOTHING
    out = {}
    for (host, f), t in named.items():
        same = alike.get((host, family(t)), [])
        if t in same and len(same) > 1:
            total, bad, pull = sum(n[host, x] for x in same), sum(b[host, x] for x in same), 0.5
        else:
            purity = 0.5
            for d in range(1, len(t)):
                beside_n = node_n[host, t[:d]] - node_n[host, t[:d + 1]]
                beside_b = node_b[host, t[:d]] - node_b[host, t[:d + 1]]
                purity = (beside_b + a * (purity + 0.5) / 2) / (beside_n + a)
            total, bad, pull = n[host, t], b[host, t], (purity + 0.5) / 2
        out[host, f] = ("/".join(t), (bad + a * pull) / (total + a))
    return form, out


def check(df):
    raw = [(r.page_id, *plain_parts(r.url)) for r in df.select("page_id", "url").collect()]
    ruled = [plain_rule(h, p) for _, h, p in raw]
    label = {"block": 1, "allow": 0, None: None}
    form, judged = plain_templates([(h, p, label[v]) for (_, h, p), (_, v) in zip(raw, ruled)])
    want = []
    for (page, host, path), (rule, verdict) in zip(raw, ruled):
        template, purity = judged[host, form[host, path]]
        verdict = verdict or ("block" if purity >= url_filter.REJECT else "allow")
        want.append((page, host, path, rule, verdict, template, round(purity, 9)))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9))
           for r in url_filter.filter_urls(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def test_whole_pages_table(small):
    rows = check(small("pages"))
    assert {w[4] for w in rows} == {"allow", "block"}
    # urls that no rule fits have a purity of their own
    assert any(abs(w[6] - 0.5) > 0.01 for w in rows if w[3] is None)


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/1", "x://example.com",
            "http://example.com/en/", "http://a.b.example.com/en/x?y=/fr/", "http://net/es/1",
            "http://badnet/es/1", "https://h.net/fr/a#b", "http://h.org/a//b/", "http://É.net/fr/1",
            "http://a.com?x=http://b.net/es/", "http://x.net/es"]
    urls += [f"http://h.net/es/{w}/1" for w in "abcdefghijkl"] * 2
    urls += [f"http://big.net/{'fr' if i % 2 else 'en'}/name{chr(97 + i % 26)}{chr(97 + i // 26)}/deadbeefdeadbeef{i:02d}"
             for i in range(120)] + [f"http://deep.net/fr/{'/'.join('abc' * 200)}"]
    df = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(urls)] * 2,
                               "page_id long, url string, host string, verdict string")
    check(df)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_judged_urls_reject_their_template(spark):
    df = spark.createDataFrame([(1, "http://spam.org/buy/77"), (2, "http://spam.org/read/77")],
                               "page_id long, url string")
    judged = spark.createDataFrame([(f"http://spam.org/buy/{i}", 1) for i in range(30)]
                                   + [(f"http://spam.org/read/{i}", 0) for i in range(30)],
                                   "url string, blocked int")
    rows = {r.page_id: r.verdict for r in url_filter.filter_urls(df, judged=judged).collect()}
    assert rows == {1: "block", 2: "allow"}


def test_two_variable_segments_are_one_template(spark):
    names = [(f"n{chr(97 + i % 26)}{chr(97 + i // 26)}", f"s{chr(97 + i // 26)}{chr(97 + i % 26)}")
             for i in range(60)]
    judged = spark.createDataFrame([(f"http://bad.org/u/{a}/{b}", 1) for a, b in names]
                                   + [("http://bad.org/about", 0)] * 3, "url string, blocked int")
    df = spark.createDataFrame([(1, "http://bad.org/u/someone/words"), (2, "http://bad.org/about"),
                                (3, "http://other.org/u/someone/words"), (4, "http://bad.org/u/a/b/more")],
                               "page_id long, url string")
    rows = {r.page_id: (r.template, r.verdict, r.purity) for r in
            url_filter.filter_urls(df, judged=judged).collect()}
    assert rows[1][:2] == ("/u/*/*", "block") and rows[2][:2] == ("/about", "allow")
    assert rows[3][1:] == ("allow", 0.5)
    # no labels of its own: it follows the node above, less than that node's own labels say
    assert 0.5 < rows[4][2] < rows[1][2]


def test_urls_of_any_depth(spark):
    urls = ["http://h.net/fr" + f"/a{i % 3}b" * n for i, n in enumerate((1, 14, 15, 16, 17, 60000))]
    urls += ["http://t.org/" + "/".join(chr(97 + (i * 7 + d) % 26) + chr(97 + i // 26) for d in range(20))
             for i in range(60)] + ["http://star.org/*/" + chr(97 + i) for i in range(25)] * 3
    check(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))


def test_url_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet')")
    got = queries.REGISTRY["op5_url_filter"](spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op5_url_filter']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def plain_canonical(text):
    out = "\n".join("" if re.search(licence_scan.COPYRIGHT_LINE, line)
                    and not re.search(licence_scan.PROTECTED_LINE, line) else line
                    for line in (text or "").lower().split("\n"))
    for a, b in licence_scan.SPELLINGS:
        out = out.replace(a, b)
    return re.sub(r"[\W_]+", " ", out).strip()


def test_licence_cases(documents):
    mit = licence_scan.MIT
    rows = [(1, mit), (2, mit.upper().replace("<year> <copyright holders>", "2020 Someone, Inc.")),
            (3, mit.replace("license", "licence").replace(",", " ;\n")), (4, mit + " more"),
            (5, "text\nLicensed under CC BY-NC 4.0.\nlicensed under cc by nc 4.0\nReleased under the MIT licence!"),
            (6, None), (7, ""), (8, "Copyright 2020 x"), (9, licence_scan.ZERO_BSD), (9, licence_scan.ZERO_BSD),
            (None, licence_scan.ZLIB), (10, "x " * 60000 + "\nLicensed under CC BY-NC 4.0.")]
    known = collections.defaultdict(set)
    for name, scope, text in licence_scan.KNOWN:
        known[scope, hashlib.sha256(plain_canonical(text).encode()).hexdigest()].add(name)
    want = []
    for doc_id, text in rows:
        def look(scope, t):
            return known.get((scope, hashlib.sha256(plain_canonical(t).encode()).hexdigest()), set())
        whole = "|".join(sorted(look("text", text))) or None
        lines = sorted({"|".join(sorted(look("notice", x))) for x in (text or "").split("\n")} - {""})
        want.append((doc_id, whole, len(lines), ",".join(lines)))
    got = [tuple(r) for r in licence_scan.scan_licences(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [w[1] for w in want[:4]] == ["MIT", "MIT", "MIT", None]
    assert licence_scan.scan_licences(documents([])).count() == 0


def test_licences_in_every_wrap_and_title(documents):
    import textwrap

    rows, want = [], {}
    for licence, scope, text in licence_scan.KNOWN + licence_scan.TITLED:
        for width in (20, 40, 60, 66, 72, 76, 80, 100, 2000) if scope == "text" else ():
            paragraphs = [textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n")]
            # a notice is a line of its own
            paragraphs = ["Copyright (c) 2020 Some One" if p.lower().startswith("copyright (c)") else p
                          for p in paragraphs]
            want[len(rows)] = licence
            rows.append((len(rows), "\n\n".join(paragraphs)))
    for notice in ("Copyright Some Company, Inc.", "(c) Some One", "Copyright <year> <owner>", "© 2020 x"):
        want[len(rows)] = "ISC"
        rows.append((len(rows), f"{notice}\n\n{licence_scan.ISC}"))
    assert any("\ncopyright notice" in t for _, t in rows) and any("\nCOPYRIGHT HOLDERS" in t for _, t in rows)
    scanned = licence_scan.scan_licences(documents(rows)).collect()
    assert {r.doc_id: r.licence for r in scanned} == want
    # the SQL finds the same in every wrap, and so do lines in the middle of other texts
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = con.execute(f"SELECT doc_id, licence, n_notices, notices FROM ({queries.ORACLE_SQL['op2_licence_scan']})")
    assert sorted(map(tuple, sql.fetchall())) == sorted(map(tuple, scanned))


def test_licence_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    got = queries.REGISTRY["op2_licence_scan"](spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op2_licence_scan']})").fetchall()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want)
    assert sum(r[2] for r in rows) > 5
