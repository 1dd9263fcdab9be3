"""Extractors, source scans, text functions, search and streams on small inputs."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import retrieval, search
from lodestone.sources import code_files, extract, storage
from lodestone.streaming import changes


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("getHTTPServer_name::parseFile a"))) == ["get", "httpserver", "name", "parse", "file"]
    assert one(spark, T.trigrams(F.lit("ab"))) == ["  a", " ab", "ab "]
    assert one(spark, T.half_up(F.lit(-2.5))) == -2 and one(spark, T.half_up(F.lit(1.005 * 100 / 100), 2)) in (1.0, 1.01)
    assert one(spark, T.normal_path(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert one(spark, T.language_of(F.lit("x/Y.TSX"))) == "tsx" and one(spark, T.language_of(F.lit("x/y.txt"))) is None
    assert one(spark, T.lines_between(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(9), 2)) == "b\nc"
    assert one(spark, T.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3
    for path, want in (("src/a.test.ts", True), ("x/__tests__/b.py", True), ("test_x.py", False), ("A.SPEC.JSX", True)):
        assert one(spark, T.is_test_path(F.lit(path))) is want
    for pattern, path, want in (("src/**", "src/a/b.ts", True), ("src/*/b.ts", "src/a/b.ts", True), ("src/*/b.ts", "src/a/c/b.ts", False), ("**/b.ts", "a/c/b.ts", True), ("**/b.ts", "b.ts", True), ("*.ts", "a.ts", False), ("src/**/b.ts", "src/b.ts", True), ("**", "any/thing", True), ("src/app.ts", "src/appxts", False)):
        assert one(spark, F.lit(path).rlike(T.segment_glob(pattern))) is want, (pattern, path)
    assert one(spark, F.lit("SRC/mod1/x.py").rlike(T.loose_glob("mod?/*.py")))


def test_query_grammar():
    q = search.parse_query("Kind:Function lang:python file:src/App name:foo role:Dead exported:1 bar-baz other:x")
    assert (q.kind, q.lang, q.file, q.name, q.role, q.exported) == ("function", "python", "src/App", "foo", "dead", True)
    assert q.terms == ["foo", "bar", "baz", "other", "x"]
    assert search.parse_query("exported:false").exported is False and search.parse_query("language:c path:x").file == "x" and not search.parse_query("").filters


def symbols(spark, rows):
    return spark.createDataFrame([(k + 1, n, q, "", "", x) for k, (n, q, x) in enumerate(rows)], "id long, name string, qualified_name string, signature string, doc string, exported int")


def test_keyword_and_fuzzy_search(spark):
    rows = symbols(spark, [("build", "a::build", 1), ("buildContext", "a::buildContext", 1)])
    assert [(r.name, r["rank"]) for r in search.keyword_search(rows, "build").collect()] == [("build", -110), ("buildContext", -60)]
    rows = symbols(spark, [("helper", "a::helper", 0), ("helper", "b::helper", 1)])
    assert [(r.id, r["rank"]) for r in search.keyword_search(rows, "helper").collect()] == [(2, -110), (1, -100)]
    rows = symbols(spark, [(n, n, 1) for n in ("handleRequest", "handleResponse", "processData", "validateInput")])
    found = search.fuzzy_search(rows, "handleReqeust").collect()
    assert [(r.name, round(-r["rank"], 6)) for r in found] == [("handleRequest", 0.671795), ("handleResponse", 0.485714)]
    assert [(r.name, round(-r["rank"], 6)) for r in search.fuzzy_search(rows, "handlResp").collect()] == [("handleResponse", 0.490476)]
    assert search.fuzzy_search(rows, "zzzzxyzzy", threshold=0.5).count() == 0
    assert search.keyword_search(rows, " ?! ").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, -2.0, 3.0, 0.5])], "vec_id long, embedding array<float>")
    row = retrieval.build_index(df).first()
    assert math.isclose(row.scale, 0.023598425196850393, rel_tol=1e-12) and row.q == [42, -85, 127, 21] and row.q_sum == 105
    x = np.random.default_rng(1).standard_normal((5, 64))
    assert np.allclose(np.linalg.norm(V.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(V.hadamard(V.hadamard(x)), x)
    with pytest.raises(ValueError, match="power of two"):
        V.hadamard(np.ones((1, 6)))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = retrieval.build_index(vectors)
    queries = vectors.filter("vec_id % 50 = 0")
    recall = retrieval.recall(retrieval.VectorIndex.of(vectors).search(queries.select("vec_id", "embedding"), 10), retrieval.search_exact(vectors, queries, 10), 10)
    assert recall.first().recall > 0.85


def by_name(found):
    return {s["name"]: s for s in found.symbols}


def called(found):
    return {(c["name"], c.get("receiver"), (c["enclosing"] or "::").split("::")[1]) for c in found.calls}


def test_python_extractor():
    found = extract.python("m.py", 'import os, sys\nfrom a.b import c as d, e\n\nclass Box(Base, Other):\n    """A box."""\n    def open(self, x):\n        self.lid.lift(x)  # not_a_call()\n        return helper("inner()")\n\ndef _private():\n    def inner():\n        pass\n    if check(1):\n        print(2)\n\nrun()\n')
    s = by_name(found)
    assert (s["Box"]["kind"], s["Box"]["extends"], s["Box"]["doc"], s["Box"]["exported"]) == ("class", "Base", "A box.", 1)
    assert s["open"]["kind"] == "method" and s["open"]["qualified_name"] == "m.py::Box.open" and s["inner"]["kind"] == "method" and s["_private"]["exported"] == 0
    assert [(i["source"], i["specifiers"]) for i in found.imports] == [("os", []), ("sys", []), ("a.b", ["c", "e"])]
    assert called(found) == {("lift", "lid", "Box.open"), ("helper", None, "Box.open"), ("check", None, "_private"), ("run", None, "")}


def test_c_extractors():
    found = extract.c_family("m.c", '#include <stdio.h>\n#define TWICE(x) twice(x)\n/* void no(void) { } */\ntypedef unsigned int word;\nstruct point { int x; };\nenum color { RED };\nstatic int add(int a, int b) {\n  return a + b;\n}\nint main(void) {\n  printf("f(x)");\n  return add(1, 2);\n}\n', False)
    s = by_name(found)
    assert {n: v["kind"] for n, v in s.items()} == {"word": "type_alias", "point": "struct", "color": "enum", "add": "function", "main": "function"}
    assert s["add"]["exported"] == 0 and s["main"]["start_line"] == 10 and s["main"]["end_line"] == 13
    assert called(found) == {("printf", None, "main"), ("add", None, "main")} and found.imports[0]["source"] == "stdio.h"
    found = extract.c_family("m.cpp", "namespace app {\nclass Queue : public Base {\npublic:\n  void push(int x) { store.add(x); }\n};\nint run() { Queue q; q.push(1); return 0; }\n}\n", True)
    s = by_name(found)
    assert (s["Queue"]["extends"], s["push"]["kind"], s["push"]["qualified_name"], s["run"]["qualified_name"]) == ("Base", "method", "m.cpp::app.Queue.push", "m.cpp::app.run")
    assert ("push", "q", "app.run") in called(found) and ("add", "store", "app.Queue.push") in called(found)


def test_shell_extractors():
    found = extract.shell("d.sh", "#!/bin/sh\nsource ./lib.sh\nalias ll='ls -l'\ndeploy() {\n  local x=1\n  build_all | sudo upload --now && notify \"call me\"\n}\nfunction check {\n  echo hi\n}\nif check; then deploy; fi\n")
    assert {n: v["kind"] for n, v in by_name(found).items()} == {"deploy": "function", "check": "function", "ll": "variable"}
    assert called(found) >= {("build_all", None, "deploy"), ("upload", None, "deploy"), ("notify", None, "deploy"), ("check", None, ""), ("deploy", None, "")}
    assert found.imports[0]["source"] == "./lib.sh"
    found = extract.powershell("p.ps1", "Import-Module Az\nclass Job : Base {\n}\nfunction Start-Job2 {\n  <# Get-No #>\n  Get-Item $x | Write-Thing\n}\nStart-Job2\n")
    assert by_name(found)["Job"]["extends"] == "Base" and found.imports[0]["source"] == "Az"
    assert called(found) == {("Get-Item", None, "Start-Job2"), ("Write-Thing", None, "Start-Job2"), ("Start-Job2", None, "")}


def test_javascript_extractor():
    code = "import def, { a as b, type T } from './lib';\nexport { x, y as z } from './more';\nexport class Shop extends Base implements Can {\n  items = [];\n  constructor(n) { super(n); }\n  async add(item) {\n    if (this.ok(item)) { return save(item); }\n  }\n  find = (id) => this.items.find(i => i.id === id);\n}\nexport const total = (xs) => xs.reduce((s, x) => s + price(x), 0);\nconst hidden = 5;\nexport const LIMIT = 10;\nfunction helper(a: string): void { log(`x ${a}`); new Shop(1); }\nexport interface Can { add(x: number): void }\nexport type Id = string;\nenum Kind { A }\nconst lazy = () => import('./lazy');\n// fake(1)\n"
    found = extract.javascript("s.ts", code)
    s = by_name(found)
    kinds = {n: v["kind"] for n, v in s.items()}
    assert kinds == {"Shop": "class", "constructor": "method", "add": "method", "find": "method", "total": "function", "LIMIT": "variable", "helper": "function", "Can": "interface", "Id": "type_alias", "Kind": "enum", "lazy": "function", "x": "variable", "z": "variable"}
    assert (s["Shop"]["extends"], s["Shop"]["implements"], s["add"]["qualified_name"], s["add"]["exported"]) == ("Base", "Can", "s.ts::Shop.add", 0)
    assert (s["total"]["exported"], s["helper"]["exported"], s["add"]["start_line"], s["add"]["end_line"]) == (1, 0, 6, 8)
    assert {("ok", "this", "Shop.add"), ("save", None, "Shop.add"), ("price", None, "total"), ("log", None, "helper"), ("Shop", None, "helper")} <= called(found)
    assert not any(c["name"] in ("fake", "if", "super") for c in found.calls)
    assert [(i["source"], i["is_dynamic"], i["specifiers"]) for i in found.imports] == [("./lib", False, ["def", "a", "T"]), ("./more", False, ["x", "y"]), ("./lazy", True, [])]


def test_extract_files_and_routes(spark):
    files = spark.createDataFrame(
        [
            ("a.py", "python", "from flask import Flask\n@app.route('/users', methods=['GET', 'POST'])\ndef users():\n    return load()\n"),
            ("b.ts", "typescript", "router.get('/items/:id', showItem);\n"),
            ("pages/blog/index.tsx", "tsx", "export function Page() { return render(); }\n"),
            ("urls.py", "python", "urlpatterns = [path('about/', views.about)]\n"),
            ("f.py", "python", "@app.get('/fast')\nasync def fast():\n    pass\n"),
            ("n.txt", None, None),
        ],
        "path string, language string, content string",
    )
    rows = extract.extract_files(files).collect()
    assert {(r.path, r.record, r.name) for r in rows if r.record != "import"} >= {("a.py", "symbol", "users"), ("a.py", "call", "load"), ("pages/blog/index.tsx", "symbol", "Page")}
    found = {(r.path, r.method, r.pattern, r.handler, r.line, r.framework) for r in extract.routes(files).collect()}
    assert found == {("a.py", "GET,POST", "/users", "users", 2, "flask"), ("b.ts", "GET", "/items/:id", "showItem", 1, "express"), ("pages/blog/index.tsx", "*", "/blog", "default", 1, "nextjs"), ("urls.py", "*", "/about/", "about", 1, "django"), ("f.py", "GET", "/fast", "fast", 1, "fastapi")}


def test_routes():
    of = lambda path, language, text: extract.routes_of(path, language, text)
    assert of("pages/api/users/[id].ts", "typescript", "export default function handler(req, res) {}") == [("*", "/api/users/:id", "handler", 1, "nextjs")]
    assert of("app/api/[...all]/route.ts", "typescript", "") == [("*", "/api/*all", "default", 1, "nextjs")]
    assert extract.page_route("src/pages/about.mdx") == "/about" and extract.page_route("src/page.ts") is None
    text = "app.get(`/a`, auth, show);\napp.use('/a', router1);\nrouter.post('/b', (req, res) => {});\napp.get('/a', show);\napp.get('/a', show);\n"
    assert of("s.ts", "typescript", text) == [("GET", "/a", "show", 1, "express"), ("USE", "/a", "router1", 2, "express"), ("POST", "/b", "res", 3, "express"), ("GET", "/a", "show", 4, "express"), ("GET", "/a", "show", 5, "express")]
    assert of("r.jsx", "jsx", '<Route exact path="/home" component={Home} />\n<Route path="/x" element={<Page/>} />') == [("*", "/home", "Home", 1, "react-router"), ("*", "/x", "Page", 2, "react-router")]
    assert of("u.py", "python", "url('old/', views.old)\nre_path(r'^new$', new.view)\n") == [("*", "/old/", "old", 1, "django"), ("*", "/^new$", "new.view", 2, "django")]
    assert of("f.py", "python", "@router.options('/o')\n@x\nasync def o():\n  pass\n@app.head('/h')\ndef h(): pass\n@app.route('/f')\ndef f(): pass\n") == [("GET", "/f", "f", 7, "flask"), ("OPTIONS", "/o", "o", 1, "fastapi"), ("HEAD", "/h", "h", 5, "fastapi")]


def test_calls_that_show_at_run_time(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "export function run() {\n  bus.on('x', f);\n  list.map(g);\n}\n"), ("b.tsx", "tsx", "export function Page() {\n  return <Box><Item a={1}/><Item/></Box>;\n}\n")], "path string, language string, content string")
    found = extract.extract_files(files)
    assert {(r.source_qname, r.target_name, r.kind, r.via, r.line) for r in extract.registration_calls(found).collect()} == {("a.ts::run", "on", "event-emitter", "bus.on", 2), ("a.ts::run", "map", "hof", "list.map", 3)}
    shown = extract.rendered_components(files, spark.createDataFrame([("b.tsx", "Page")], "path string, name string"))
    assert {tuple(r) for r in shown.collect()} == {("b.tsx", "b.tsx::Page", "Box", 2), ("b.tsx", "b.tsx::Page", "Item", 2)}


def tree(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}")
    return f"file://{root}"


def test_scan_and_ignore(spark, tmp_path):
    for name, body in (("src/a.ts", "x"), ("src/b.py", "y"), ("dist/c.ts", "z"), ("src/gen/d.ts", "w"), ("src/gen/keep.ts", "k"), (".hidden/e.ts", "h"), ("notes.txt", "n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    root = f"file://{tmp_path}"
    assert {r.path for r in code_files.scan(spark, root).collect()} == {"src/a.ts", "src/b.py", "src/gen/d.ts", "src/gen/keep.ts"}
    rules = code_files.ignore_rules({"": "*.py\n", "src/": "gen/*\n!gen/keep.ts\n# no\n"})
    found = code_files.scan(spark, root, rules, ignore_folders=()).collect()
    assert {(r.path, r.language) for r in found} == {("src/a.ts", "typescript"), ("dist/c.ts", "typescript"), ("src/gen/keep.ts", "typescript")}
    assert {r.content for r in found} == {"x", "z", "k"}
    assert "dist/c.ts" not in {r.path for r in code_files.scan(spark, root, rules).collect()}


def test_scan_loses_no_file(spark, tmp_path):
    """Names that Spark's readers pass over, all extensions, folders that are deep, and names with spaces."""
    own = tmp_path / "a tree"
    kept = ["pkg/a.py", "pkg/__init__.py", "__main__.py", "web/_app.tsx", "pkg/b.pyi", "c/h.hh", "bin/z.zsh", "vendor/c.py", "target/d.c", "_private/x.py", "a/b/_c/d/e/f.py", "a/b/c/d/e/_g.py", "a/b/c/d/e/h.py", "x y/_z.JS", *(f"all/f.{x}" for x in T.LANGUAGES)]
    lost = [".hidden/_e.ts", "a/.h/_x.py", "_out/n.txt", "node_modules/m/_i.js", "src/node_modules/j.js", "dist/_k.py", "a/build/l.py", ".nuxt/x.ts", "x.md"]
    found = code_files.scan(spark, tree(own, *kept, *lost)).collect()
    assert sorted(r.path for r in found) == sorted(kept)
    assert all(r.content == f"# {r.path}" and r.size == len(r.content) and r.language for r in found)


def test_scan_opens_only_what_is_left(spark, tmp_path):
    """Files of 3 GB that are ignored, by folder or by rule, are listed at most; one that is wanted and too large is an error."""
    root = tree(tmp_path, "a.py", "src/b.py", "gen/c.py")
    (tmp_path / ".gitignore").write_text("huge*.py\n")
    for name in ("node_modules/lib/i.js", "src/huge1.py", ".git/objects/pack.py", "blob.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with open(tmp_path / name, "wb") as f:
            f.truncate(3 << 30)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 20))
    try:
        assert {(r.path, r.size) for r in code_files.scan(spark, root).collect()} == {("a.py", 6), ("src/b.py", 10), ("gen/c.py", 10)}
        with open(tmp_path / "gen/c.py", "wb") as f:
            f.truncate(2 << 20)
        with pytest.raises(Exception, match="maxLength"):
            code_files.scan(spark, root).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_listing_in_rounds(spark, tmp_path, monkeypatch):
    """Folders are handed on from round to round, and files that go before they are read are left out."""
    names = [f"{'/'.join('abc'[k % 3] + str(k) for k in range(d))}/f{d}.py".lstrip("/") for d in range(9)] + [f"w{k}/x.py" for k in range(40)]
    root = tree(tmp_path, *names)
    monkeypatch.setattr(code_files, "TASK_ENTRIES", 3)
    monkeypatch.setattr(code_files, "READ_BYTES", 50)
    found = code_files.listing(spark, root)
    assert sorted(r.path for r in found.files.collect()) == sorted(names) and found.ignore_files == {}
    (tmp_path / "w7/x.py").unlink()
    read = code_files.read_files(found.files, found.uri)
    assert {r.path: bytes(r.content) for r in read.collect()} == {n: f"# {n}".encode() for n in names if n != "w7/x.py"}
    assert code_files.scan(spark, tree(tmp_path / "empty", "x.txt")).count() == 0


def test_ignore_files_of_the_tree(spark, tmp_path):
    root = tree(tmp_path, "a.py", "logs/b.py", "src/logs/c.py", "src/gen/d.py", "src/gen/keep.py", "src/x/y/only.py", "src/x/y/z/deep.py", "top/e.py", "sub/top/e.py", "tmp1.py")
    (tmp_path / ".gitignore").write_text("# all\nlogs/\n/top\ntmp?.py\nsrc/gen/*\n!src/gen/keep.py\n")
    (tmp_path / "src/x/y/.gitignore").write_text("only.py\n")
    (tmp_path / "src/x/y/z/.gitignore").write_text("a.py\n")  # too deep to be read
    assert {r.path for r in code_files.scan(spark, root).collect()} == {"a.py", "src/gen/keep.py", "src/x/y/z/deep.py", "sub/top/e.py"}


def test_ignore_patterns():
    import re

    def ignores(text, path, base=""):
        out = False
        for r in code_files.ignore_rules({base: text}):
            out = not r.negated if re.search(r.pattern, path) else out
        return out

    assert ignores("", "node_modules/x.js") and ignores("", "a/.git/x") and not ignores("", "src/node_modules.ts")
    assert ignores("build", "a/build/x.py") and ignores("build", "build") and not ignores("build", "rebuild/x.py")
    assert ignores("/dist", "dist/x") and not ignores("/dist", "a/dist/x") and ignores("/gen", "src/gen/x", "src/") and not ignores("/gen", "gen/x", "src/")
    assert ignores("a/**/b.py", "x/a/q/r/b.py") and ignores("*.log", "a/b.log") and not ignores("*.log", "a/b.logs")
    assert ignores("out/\n!out/keep", "out/x") and not ignores("out/\n!out/keep", "out/keep")
    assert ignores_default("dist/x.py") and not ignores_default("vendor/x.py")


def ignores_default(path):
    import re

    return any(re.search(r.pattern, path) for r in code_files.ignore_rules({}))


def test_diffs(spark):
    lines = spark.createDataFrame([("A\tnew.py",), ("M\told.py",), ("R100\ta.py\tb.py",), ("D\tgone.py",), ("",)], "value string")
    assert {tuple(r) for r in code_files.name_status(lines).collect()} == {("new.py", "added"), ("old.py", "modified"), ("b.py", "renamed"), ("gone.py", "deleted")}
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n+x\n@@ -9 +12 @@\n-a\n+b\n@@ -20,2 +22,0 @@\n-z\n"
    found = code_files.hunks(spark.createDataFrame([("x", diff)], "path string, diff string"))
    assert {tuple(r) for r in found.collect()} == {("x", 3, 6), ("x", 12, 12)}


def test_storage(spark):
    edges = spark.createDataFrame([(1, 1, 2, "calls"), (2, 1, 2, "calls"), (3, 1, 2, "imports")], storage.EDGES)
    assert sorted(r.id for r in storage.distinct_edges(edges).collect()) == [1, 3]
    nodes = spark.createDataFrame([(1, 1, "q"), (2, 1, "q"), (3, 2, "q")], "id long, file_id long, qualified_name string")
    assert sorted(r.id for r in storage.latest_nodes(nodes).collect()) == [2, 3]


def test_debounce_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = f"file://{tmp_path}/in"
    events.write.parquet(source)
    late = spark.createDataFrame([(-1, datetime.datetime(2030, 1, 1), -1, "view", 0.0, None)], events.schema)
    query = changes.debounce_stream(spark, source, events.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/check", "4 hours", "0 seconds")
    query.awaitTermination()
    late.write.mode("append").parquet(source)  # moves the watermark past all sessions
    for _ in range(2):
        changes.debounce_stream(spark, source, events.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/check", "4 hours", "0 seconds").awaitTermination()
    got = {(r.user_id, r.start, r.n, tuple(r["items"])) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r.user_id, r.start, r.n, tuple(r["items"])) for r in changes.debounced(events, "4 hours", "user_id", "event_type").collect()}
    assert got == want


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "license the Version"), (2, "ΑΣ'Β x"), (3, None)], "id long, text string")
    found = search.keyword_search(docs, "ας", None, ("text",), None)
    assert [r.id for r in found.collect()] == [2] or found.count() == 0  # by the tokens alone
    scores = search.bm25(docs, "license the", T.tokens(F.coalesce("text", F.lit("")), T.QUERY_PUNCTUATION))
    assert [r.id for r in scores.collect()] == [1]


def test_javascript_doc_comments():
    code = "/** Adds. */\nfunction add(a) { return a; }\n// not a block\nfunction plain() {}\n/* of the export */\nexport function out() {}\nclass A {\n  /** Runs. */\n  run() { return 1; }\n}\n"
    docs = {s["name"]: s["doc"] for s in extract.javascript("a.ts", code).symbols}
    assert docs == {"add": "* Adds.", "plain": None, "out": None, "A": None, "run": "* Runs."}
