"""HTTP and JSON in front of ``GraphDatabase``, on the standard library's server.

Routes are under ``/api``: health (also ``/healthz``), databases (list, create, progress, cancel, load, delete),
uploads in chunks or in one form, stats, query (alias sparql), disconnect. While a database is being created,
other routes answer 423, but for health, progress, cancel and disconnect.
"""

from __future__ import annotations

import base64
import email
import email.policy
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from tessera.plans.sparql import QueryError
from tessera.service.database import DatabaseError, GraphDatabase
from tessera.sources import fs
from tessera.sources.ntriples import InvalidTriples
from tessera.streaming.upload import UploadError, Uploads

PAGE = """<!doctype html><meta charset="utf-8"><title>Graph queries</title>
<style>body{font:15px sans-serif;max-width:60em;margin:2em auto}textarea{width:100%;height:8em}td,th{border:1px solid #ccc;padding:2px 6px}table{border-collapse:collapse}</style>
<h1>Graph queries</h1><p>Database <select id="db"></select> <button id="load">Load</button> <button id="drop">Delete</button></p>
<p>New <input id="name" placeholder="name"> <input id="nt" type="file" accept=".nt"> <button id="make">Create</button></p>
<textarea id="q">SELECT * WHERE { ?s ?p ?o } LIMIT 20</textarea><p><button id="run">Run</button> <span id="say"></span></p><table id="out"></table>
<details><summary>JSON</summary><pre id="raw"></pre></details>
<script>
const $=i=>document.getElementById(i),call=(p,b)=>fetch('/api/'+p,b?{method:'POST',body:JSON.stringify(b)}:{}).then(r=>r.json());
const cell=(row,tag,v)=>{const c=document.createElement(tag);c.textContent=v??'';row.append(c)};
const list=()=>call('databases').then(r=>{$('db').replaceChildren();r.databases.forEach(d=>{const o=document.createElement('option');o.textContent=d.name;o.selected=d.active;$('db').append(o)})});
list();
$('drop').onclick=()=>confirm('Delete '+$('db').value+'?')&&call('databases/delete',{database:$('db').value}).then(r=>{$('say').textContent=r.error||'deleted';list()});
const step=8<<20,send=(id,n,chunk,last)=>fetch('/api/databases/upload/chunk?upload_id='+id+'&chunk='+n+'&last='+last,{method:'POST',headers:{'Content-Type':'application/octet-stream'},body:chunk}).then(r=>r.json());
$('make').onclick=async()=>{const f=$('nt').files[0];if(!f)return;
 const up=await call('databases/upload/init',{name:f.name});let r=up;
 for(let n=0,at=0;r.ok&&(at<f.size||!n);n++,at+=step)r=await send(up.upload_id,n,f.slice(at,at+step),at+step>=f.size);
 if(r.ok)r=await call('databases/create',{database:$('name').value,upload_id:up.upload_id});
 $('say').textContent=r.error||'created';list()};
$('load').onclick=()=>call('databases/load',{database:$('db').value}).then(r=>$('say').textContent=r.error||'loaded');
$('run').onclick=()=>call('query',{query:$('q').value,database:$('db').value||undefined}).then(r=>{$('out').replaceChildren();$('raw').textContent=JSON.stringify(r,null,1);
 if(!r.ok){$('say').textContent=r.error;return}
 $('say').textContent=r.results.count+' rows, '+r.metrics.elapsed_ms+' ms'+(r.results.truncated?', first '+r.results.returned_count+' shown':'');
 const h=$('out').insertRow();r.head.vars.forEach(v=>cell(h,'th',v));r.results.bindings.forEach(b=>{const t=$('out').insertRow();b.forEach(v=>cell(t,'td',v))})});
</script>"""

ALWAYS = {"health", "databases/create/progress", "databases/create/cancel", "disconnect"}


def form_of(content_type: str, body: bytes) -> tuple[dict[str, str], str | None, bytes]:
    """A multipart form: its fields, and the name and the bytes of its file, if it has one."""
    message = email.message_from_bytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body, policy=email.policy.HTTP)
    fields, name, data = {}, None, b""
    for part in message.iter_parts():
        held = part.get_payload(decode=True) or b""
        if part.get_filename() is None:
            fields[part.get_param("name", "", "content-disposition")] = held.decode()
        else:
            name, data = part.get_filename(), held
    return fields, name, data


class Service:
    """The routes, apart from sockets: (method, path, parameters, body) to (status, answer)."""

    def __init__(self, db: GraphDatabase, upload_folder: str) -> None:
        self.db, self.uploads = db, Uploads(upload_folder)
        self.closed = threading.Event()

    def handle(self, method: str, path: str, params: dict[str, str], body: bytes = b"", content_type: str = "") -> tuple[int, dict | str]:
        if path in ("/", "/ui", "/ui/"):
            return 200, PAGE
        route = "health" if path == "/healthz" else path.removeprefix("/api/").strip("/")
        if self.db.building and route not in ALWAYS and route != "databases/create":
            return 423, {"ok": False, "error": "a database is being created"}
        try:
            fields = dict(params)
            if content_type.startswith("multipart/form-data"):
                form, name, body = form_of(content_type, body)
                fields |= form | ({"file_name": name} if name else {})
            elif body and "octet-stream" not in content_type and (body.lstrip()[:1] == b"{" or "json" in content_type):
                try:
                    fields |= json.loads(body)
                except ValueError:
                    if "json" in content_type:
                        return 400, {"ok": False, "error": "the body is not JSON"}
            found = self.routes().get((method, route))
            if found is None:
                known = any(r == route for _, r in self.routes())
                return (405, {"ok": False, "error": "method not allowed"}) if known else (404, {"ok": False, "error": "no such route"})
            answer = found(fields, body)
            return 200, {"ok": True} | answer
        except (QueryError, UploadError, InvalidTriples) as e:
            return 400, {"ok": False, "error": str(e)}
        except DatabaseError as e:
            return e.status, {"ok": False, "error": str(e)}
        except KeyError as e:
            return 400, {"ok": False, "error": f"missing field {e.args[0]!r}"}
        except Exception as e:
            return 500, {"ok": False, "error": f"{type(e).__name__}: {e}"[:500]}

    def routes(self) -> dict:
        db = self.db
        return {
            ("GET", "health"): lambda f, b: {"status": "ok"},
            ("GET", "databases"): lambda f, b: {"databases": db.listing(), "active": db.active},
            ("GET", "database"): lambda f, b: {"database": db.active, "stats": db.stats()},
            ("GET", "stats"): lambda f, b: {"stats": db.stats(f.get("database"))},
            ("POST", "databases/upload/init"): lambda f, b: {"upload_id": self.uploads.begin(f["name"])},
            ("POST", "databases/upload/chunk"): self._chunk,
            ("POST", "databases/create"): self._create,
            ("GET", "databases/create/progress"): lambda f, b: db.progress.as_dict(),
            ("POST", "databases/create/cancel"): lambda f, b: {"cancelled": db.cancel()},
            ("POST", "databases/load"): lambda f, b: {"database": f["database"], "predicates": len(db.load(f["database"]).by_predicate)},
            ("POST", "databases/delete"): lambda f, b: db.drop(f["database"]) or {"deleted": f["database"]},
            ("GET", "query"): self._query, ("POST", "query"): self._query, ("GET", "sparql"): self._query, ("POST", "sparql"): self._query,
            ("POST", "disconnect"): lambda f, b: self.closed.set() or {"status": "closing"},
        }

    def _chunk(self, fields: dict, body: bytes) -> dict:
        data = base64.b64decode(fields["data"]) if fields.get("encoding") == "base64" else fields["data"].encode() if "data" in fields else body
        up = self.uploads.chunk(fields["upload_id"], int(fields["chunk"]), data, str(fields.get("last", "")).lower() in ("1", "true"))
        return {"next_chunk": up.next_chunk, "size": up.size}

    def _create(self, fields: dict, body: bytes) -> dict:
        key = fields.get("upload_id")
        if not key and "file_name" in fields:
            key = self.uploads.begin(fields["file_name"])
            self.uploads.chunk(key, 0, body, True)
        own = os.path.abspath(self.uploads.take(key)) if key else None
        path = fs.put(self.db.spark, own) if own else fields["file"]
        try:
            return {"database": fields["database"], "progress": self.db.create(fields["database"], path).as_dict()}
        finally:
            if key:
                self.uploads.drop(key)
                if path != own:
                    fs.delete(self.db.spark, path)

    def _query(self, fields: dict, body: bytes) -> dict:
        text = fields.get("query") or body.decode()
        if not text.strip():
            raise QueryError("no query")
        answer = self.db.answer(text, fields.get("database")).as_dict()
        return answer | {"database": self.db.active, "database_stats": self.db.stats()}


def serve(db: GraphDatabase, upload_folder: str, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound and ready; ``serve_forever`` runs it until ``disconnect``."""
    service = Service(db, upload_folder)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _do(self) -> None:
            url = urlparse(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            kind = self.headers.get("Content-Type") or ""
            params = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if "x-www-form-urlencoded" in kind:
                params |= {k: v[-1] for k, v in parse_qs(body.decode()).items()}
                body = b""
            status, answer = service.handle(self.command, url.path, params, body, kind) if self.command != "OPTIONS" else (204, "")
            data = (answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)).encode()
            self.send_response(status)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(k, v)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(answer, str) else "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            if service.closed.is_set():
                threading.Thread(target=self.server.shutdown, daemon=True).start()

        do_GET = do_POST = do_OPTIONS = _do

    server = ThreadingHTTPServer((host, port), Handler)
    server.service = service
    return server
