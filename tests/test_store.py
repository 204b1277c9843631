import json
import threading
import urllib.error
import urllib.request

import pytest

from tessera.__main__ import main
from tessera.operators.bgp import run_query
from tessera.service.database import DatabaseError, GraphDatabase
from tessera.service.http import Service, serve
from tessera.sources.ntriples import InvalidTriples, read_triples, validate, write_triples
from tessera.streaming.upload import UploadError, Uploads

DATA = r"""# a comment
<a> <p> <b> .
<a>	<p> <b> .

<b> <p> <c>.
<c> <name> "x . y \" z"@en .
_:n <name> "\u00E9 \uD83D\uDE00" .
<c> <age> "5"^^<int> .
"""
WANT = {("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<c>", "<name>", '"x . y \\" z"@en'), ("_:n", "<name>", '"é \U0001f600"'), ("<c>", "<age>", '"5"^^<int>')}


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "g.nt"
    path.write_text(DATA)
    return str(path)


@pytest.fixture(scope="module")
def db(spark, data, tmp_path_factory):
    db = GraphDatabase(spark, str(tmp_path_factory.mktemp("root")))
    db.create("g", data)
    return db


def test_read_and_write(spark, data, tmp_path):
    triples = read_triples(spark, data)
    assert {tuple(r) for r in triples.collect()} == WANT and triples.count() == 5
    assert read_triples(spark, data, distinct=False).count() == 6
    for ascii_only in (True, False):
        out = str(tmp_path / f"out{ascii_only}.nt")
        write_triples(triples, out, ascii_only)
        assert {tuple(r) for r in read_triples(spark, out).collect()} == WANT
        assert all(r[0].isascii() for r in spark.read.text(out).collect()) or not ascii_only


@pytest.mark.parametrize(("text", "error"), [("<a> <b> <c>\n", "dot"), ("# x\n\n<a> <b> <c> .\n<a> <b> .\n", "line 4"), ("# nothing\n", "no triple"), ("<a> <b> .", "object"), ("<a> .", "lacks")])
def test_validate(spark, tmp_path, text, error):
    path = tmp_path / "x.nt"
    path.write_text(text)
    found = validate(spark, str(path))
    assert not found.ok and error in found.error


def test_validate_good(spark, data):
    found = validate(spark, data)
    assert found.ok and found.checked == 6 and not validate(spark, data.replace(".nt", ".ttl")).ok


def test_database(db, data, spark, tmp_path):
    assert db.names() == ["g"] and db.stats()["triple_count"] == 5 and db.progress.status == "success"
    assert {tuple(r) for r in db.query("SELECT ?a ?c WHERE { ?a <p> ?b . ?b <p> ?c }").collect()} == {("<a>", "<c>")}
    assert {tuple(r) for r in db.query("SELECT * WHERE { ?s ?p ?o }").collect()} == {(o, p, s) for s, p, o in WANT}
    plan = run_query(db.graph, "SELECT ?a WHERE { ?a <age> ?b }")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p_id" in plan
    assert db.explain_graph("SELECT * WHERE { ?a <p> ?b . ?b <p> ?c }")[0]["vertices"] == ["a", "b", "c"]
    for bad in (lambda: db.create("g", data), lambda: db.load("none"), lambda: db.drop("none"), lambda: db.path("../x")):
        with pytest.raises(DatabaseError):
            bad()
    wrong = tmp_path / "w.nt"
    wrong.write_text("<a> <b>\n")
    with pytest.raises(InvalidTriples):
        db.create("w", str(wrong))
    assert db.progress.status == "error" and not db.exists("w")
    db.create("h", data, load=False)
    assert db.active == "g" and len(db.listing()) == 2 and db.listing()[0]["disk_bytes"] > 0
    db.drop("h")
    assert db.names() == ["g"]


def test_rejected_lines(db, spark, tmp_path, monkeypatch):
    from tessera.service import database

    path = tmp_path / "r.nt"
    path.write_text(DATA + "<x> <y> .\nnothing\n")
    monkeypatch.setattr(database, "validate", lambda spark, file: validate(spark, file, sample=6))
    assert db.create("r", str(path), load=False).rejected == 2 and db.stats("r")["triple_count"] == 5
    db.drop("r")


def test_variable_predicate_is_one_scan(db):
    for text in ("SELECT * WHERE { ?s ?p ?o }", "SELECT * WHERE { <c> ?p ?o }", "SELECT ?p WHERE { ?s ?p <c> }"):
        df = db.query(text)
        assert df._jdf.queryExecution().executedPlan().toString().count("/triples") == 1
    assert "PushedFilters: [IsNotNull(s), EqualTo(s,<c>)" in db.query("SELECT * WHERE { <c> ?p ?o }")._jdf.queryExecution().executedPlan().toString()


def test_cancel(db, data, monkeypatch):
    from tessera.service import database

    monkeypatch.setattr(database.store, "save", lambda *a: db.cancel())
    with pytest.raises(DatabaseError):
        db.create("c", data)
    assert db.progress.status == "cancelled" and not db.exists("c")


def test_uploads(tmp_path):
    up = Uploads(str(tmp_path))
    with pytest.raises(UploadError):
        up.begin("x.ttl")
    key = up.begin("x.nt")
    up.chunk(key, 0, b"ab")
    for bad in (lambda: up.chunk(key, 2, b""), lambda: up.chunk("no", 0, b"")):
        with pytest.raises(UploadError):
            bad()
    assert up.chunk(key, 1, b"c", last=True).size == 3 and open(up.take(key), "rb").read() == b"abc"
    up.drop(key)


def test_routes(db, data, tmp_path):
    s = Service(db, str(tmp_path))
    call = lambda m, r, **f: s.handle(m, f"/api/{r}", {}, json.dumps(f).encode() if f else b"")
    assert call("GET", "health") == s.handle("GET", "/healthz", {}) == (200, {"ok": True, "status": "ok"})
    assert call("POST", "databases/load", database="none")[0] == 404 and call("POST", "databases/load")[0] == 400
    assert call("POST", "databases/load", database="g")[0] == 200
    status, answer = call("POST", "query", query="SELECT ?a WHERE { ?a <p> ?b }")
    assert status == 200 and sorted(answer["results"]["bindings"]) == [["<a>"], ["<b>"]] and answer["database_stats"]["triple_count"] == 5
    assert call("POST", "query", query="SELECT nonsense")[0] == 400 and call("GET", "nothing")[0] == 404 and call("GET", "databases/load")[0] == 405
    key = call("POST", "databases/upload/init", name="u.nt")[1]["upload_id"]
    assert call("POST", "databases/upload/chunk", upload_id=key, chunk=0, data=DATA, last=True)[1]["next_chunk"] == 1
    assert call("POST", "databases/create", database="u", upload_id=key)[0] == 200 and db.active == "u"
    assert call("POST", "databases/create", database="u", file=data)[0] == 409
    form = lambda name: f'--zz\r\nContent-Disposition: form-data; name="database"\r\n\r\nv\r\n--zz\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\n\r\n{DATA}\r\n--zz--\r\n'.encode()
    post = lambda name: s.handle("POST", "/api/databases/create", {}, form(name), "multipart/form-data; boundary=zz")
    assert post("v.ttl")[0] == 400 and post("v.nt")[0] == 200 and db.active == "v" and db.stats()["triple_count"] == 5
    assert call("POST", "databases/delete", database="v")[0] == 200 and call("POST", "databases/load", database="u")[0] == 200
    key = call("POST", "databases/upload/init", name="w.nt")[1]["upload_id"]
    raw = s.handle("POST", "/api/databases/upload/chunk", {"upload_id": key, "chunk": "0", "last": "true"}, b"{<a>", "application/octet-stream")
    assert raw[1]["size"] == 4  # bytes as they are, whatever they begin with
    assert call("POST", "databases/delete", database="u")[0] == 200 and call("GET", "database")[0] == 400
    db.progress.status = "running"
    assert call("GET", "databases")[0] == 423 and call("GET", "databases/create/progress")[0] == 200
    db.progress.status = "success"
    db.load("g")


def test_server(db, tmp_path):
    server = serve(db, str(tmp_path), port=0)
    thread = threading.Thread(target=server.serve_forever)
    thread.start()
    url = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(f"{url}/api/sparql?query=SELECT%20%3Fa%20WHERE%20%7B%20%3Fa%20%3Cage%3E%20%3Fb%20%7D") as r:
        assert json.load(r)["results"]["bindings"] == [["<c>"]] and r.headers["Access-Control-Allow-Origin"] == "*"
    assert b"Graph queries" in urllib.request.urlopen(f"{url}/ui").read()
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{url}/api/query?query=x")
    urllib.request.urlopen(urllib.request.Request(f"{url}/api/disconnect", method="POST")).read()
    thread.join(10)
    assert not thread.is_alive()
    server.server_close()


def test_command_line(spark, data, tmp_path, capsys):
    queries, root, model = tmp_path / "q.txt", str(tmp_path / "dbs"), str(tmp_path / "m.json")
    queries.write_text("SELECT ?a WHERE { ?a <p> ?b . ?b <p> ?c }\nSELECT * WHERE { ?a <name> ?b }\n")
    assert main(["build", "-d", "x", "-f", data, "--root", root, "-t", "2"], spark) == 0
    for command in ("query", "train", "test"):
        assert main([command, "-d", "x", "-f", str(queries), "--root", root, "-m", model], spark) == 0
    out = capsys.readouterr().out
    assert "query 1: 1 rows" in out and "query 2: 2 rows" in out and "average" in out
