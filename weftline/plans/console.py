"""Reads of the review console as plain values, over scored pairs (i, j, p, emitted) and source records.

Only a page's rows reach the driver.
"""

from __future__ import annotations

import json
import threading
import zipfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.tokens import shared_words
from weftline.operators import analytics, decide


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Console:
    def __init__(self, records: DataFrame, pairs: DataFrame, report: dict | None = None, resolver: Callable[[DataFrame], DataFrame] | None = None, explain: Callable[[str], dict[str, dict]] | None = None):
        self.records, self.pairs, self.report, self.resolver, self.explain = records, pairs.where("p IS NOT NULL"), report or {}, resolver, explain
        self.pruned, self.state, self.error = pairs.where("p IS NULL"), "warming", ""
        self.everyone = records.where("src = 1").select(F.col("entity_id").alias("i"))

    def warm(self) -> None:
        """Reads the tables once; until that is done the console is ``warming``, and ``error`` if it fails."""
        try:
            self.overview()
            self.state = "ready"
        except Exception as e:  # what the tables' store says is shown, not raised in a thread that nobody waits for
            self.state, self.error = "error", str(e).splitlines()[0]

    def health(self) -> dict:
        return {"status": self.state} | ({"error": self.error} if self.error else {})

    def overview(self) -> dict:
        n = self.records.agg(F.count_if(F.col("src") == 1).alias("entities"), F.count_if(F.col("src") != 1).alias("others")).first()
        p = self.pairs.agg(F.count("*").alias("pairs"), F.count_if("emitted").alias("emitted")).first()
        return {**n.asDict(), **p.asDict(), "report": self.report}

    def entities(self, kind: str = "all", search: str = "", offset: int = 0, limit: int = 50) -> list[dict]:
        named = self.records.select(F.col("entity_id").alias("i"), "business_name", "business_address", "country")
        return rows(analytics.browse(analytics.entity_flags(self.everyone, self.pairs).join(named, "i"), kind=kind, search=search, text=F.concat_ws(" ", "i", "business_name", "business_address"), offset=offset, limit=limit))

    def entity(self, one: str) -> dict:
        mine = self.pairs.where(F.col("i") == one)
        named = self.records.select(F.col("entity_id").alias("j"), "business_name", "business_address", "country")
        own = self.records.where(F.col("entity_id") == one).collect()
        text = {c: F.lit(own[0][c] if own else "") for c in ("business_name", "business_address")}
        marked = [shared_words(text[c], F.col(c)).alias(f"shared_{c.split('_')[1]}") for c in text]
        candidates = rows(mine.join(named, "j").select("*", *marked).orderBy(F.desc("p"), "j"))
        why = self.explain(one) if self.explain else {}
        for c in candidates:
            c["why"] = why.get(c["j"])
        pruned = self.pruned.where(F.col("i") == one)
        pruned = rows(pruned.join(named, "j").orderBy(F.desc("p1"), "j").limit(6)) if "p1" in pruned.columns else []  # the page shows six
        rival = rows(analytics.competing(self.pairs.join(mine.select("j"), "j", "left_semi")).where(F.col("i") == one))
        ps = np.array([c["p"] for c in candidates])
        curve = [round(float(x), 6) for x in decide._curve(np.clip(ps, 1e-9, 1 - 1e-9), decide.MOST)] if len(ps) else [1.0]
        return {"entity": own[0].asDict() if own else None, "candidates": candidates, "pruned": pruned, "curve": curve, "rivals": rival}

    def review(self, top: int = 150) -> list[dict]:
        return rows(decide.review_queue(self.pairs, top=top))

    def samples(self) -> list[dict]:
        good = self.pairs.where("emitted AND p > 0.6").select(F.col("j").alias("id")).distinct()
        named = self.records.select(F.col("entity_id").alias("id"), "business_name", "business_address", "country")
        return rows(analytics.samples(named.join(good, "id", "left_semi"), "country", "sample"))

    def resolve(self, record: dict) -> list[dict]:
        """Answers for one new record; ``resolver`` maps a table of new records to scored pairs."""
        if self.resolver is None:
            raise ValueError("no model is loaded")
        new = self.records.sparkSession.createDataFrame([(record.get("entity_id", "S1-new"), record.get("business_name", ""), record.get("business_address", ""), record.get("country", ""), 1)], "entity_id string, business_name string, business_address string, country string, src int")
        return rows(self.resolver(new).orderBy(F.desc("p"), "j"))


def serve(console: Console, port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server of the reads above; call ``serve_forever`` on it."""
    class Handler(BaseHTTPRequestHandler):
        def _say(self, value, status: int = 200):
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            plain = {"/api/health": console.health, "/api/overview": console.overview, "/api/review": console.review, "/api/samples": console.samples}
            try:
                if url.path in plain:
                    self._say(plain[url.path]())
                elif url.path == "/api/entities":
                    self._say(console.entities(q.get("kind", "all"), q.get("search", ""), int(q.get("offset", 0)), int(q.get("limit", 50))))
                elif url.path.startswith("/api/entity/"):
                    self._say(console.entity(url.path.removeprefix("/api/entity/")))
                else:
                    self._say({"error": "unknown path"}, 404)
            except (KeyError, ValueError) as e:
                self._say({"error": str(e)}, 400)

        def do_POST(self):
            try:
                record = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                self._say(console.resolve(record))
            except ValueError as e:
                self._say({"error": str(e)}, 400)

        def log_message(self, *args):
            pass

    threading.Thread(target=console.warm, daemon=True).start()
    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def report_markdown(title: str, facts: dict[str, object], tables: dict[str, list[dict]]) -> str:
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for name, rs in tables.items():
        out += ["", f"## {name}", ""]
        if rs:
            out += ["| " + " | ".join(rs[0]) + " |", "|" + "-|" * len(rs[0]), *["| " + " | ".join(str(v) for v in r.values()) + " |" for r in rs]]
    return "\n".join(out) + "\n"


def package(folder: str, out: str, required: list[str]) -> list[str]:
    """A zip of a submission's files, in order of name; missing required files are an error."""
    missing = [x for x in required if not Path(folder, x).is_file()]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    members = sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for m in members:
            z.write(Path(folder, m), m)
    return members
