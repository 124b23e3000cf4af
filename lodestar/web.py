"""Jobs over HTTP: start a run, follow it, read its tables and files. Standard library alone."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import CrawlConfig

# Limits of a hosted run, rows of a table's view, lines of a log's view, and files for download.
HOSTED = {"max_pages": 40, "max_pdfs": 20, "max_depth": 4, "concurrency": 4, "max_sitemap_urls": 250}
HOSTED_TIMEOUT, HOSTED_DELAY = 12.0, 0.25
VIEW_ROWS = {"phone_inventory": None, "phone_occurrences": 5000, "url_inventory": 8000, "crawl_errors": None}
LOG_LINES, LOG_KEPT = 200, 3000
FILES = ("phone_inventory.csv", "phone_occurrences.csv", "url_inventory.csv", "crawl_report.csv", "crawl_errors.csv", "phone_inventory.xlsx", "crawl_report.json", "crawl_report.md", "crawl.log")
POLL_MS = 1500


def hosted(config: CrawlConfig) -> CrawlConfig:
    """The config within the limits of a hosted run; pages aren't rendered there."""
    caps = {k: min(getattr(config, k) or v, v) for k, v in HOSTED.items()}
    return replace(config, **caps, timeout=min(config.timeout, HOSTED_TIMEOUT), delay=max(config.delay, HOSTED_DELAY), render_js="off")


def filter_rows(df: DataFrame, text: str = "", limit: int = 250) -> DataFrame:
    """The first rows whose JSON holds text, in either case."""
    return (df.where(F.lower(F.to_json(F.struct("*"))).contains(text.lower())) if text else df).limit(limit)


@dataclass
class Job:
    id: str
    start_url: str
    output_dir: str
    status: str = "queued"
    logs: list[str] = field(default_factory=list)
    error: str | None = None
    started_at: str | None = None
    finished_at: str | None = None
    summary: dict[str, str] = field(default_factory=dict)

    def log(self, line: str) -> None:
        self.logs.append(line)
        del self.logs[:-LOG_KEPT]

    def snapshot(self) -> dict:
        return asdict(self) | {"logs": self.logs[-LOG_LINES:]}


class Busy(RuntimeError):
    pass


class Jobs:
    """Runs one job at a time. execute(config, job) does the work and returns the summary."""

    def __init__(self, root: str, execute: Callable[[CrawlConfig, Job], dict[str, str]], wait: bool = False) -> None:
        self.root, self.execute, self.wait = os.path.realpath(root), execute, wait
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()

    def safe(self, path: str) -> str:
        """A folder inside the root."""
        at = os.path.realpath(os.path.join(self.root, path))
        if os.path.commonpath([at, self.root]) != self.root:
            raise ValueError("the output must be inside the output root")
        return at

    def start(self, payload: dict) -> Job:
        start_url = str(payload.get("start_url") or "").strip()
        if not start_url:
            raise ValueError("start_url is empty")
        known = CrawlConfig.__dataclass_fields__
        config = CrawlConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in payload.items() if k in known and k != "output_dir"} | {"start_url": start_url})
        job = Job(uuid.uuid4().hex, start_url, self.safe(str(payload.get("output_dir") or uuid.uuid4().hex)))
        config = replace(hosted(config) if self.wait else config, output_dir=job.output_dir)
        with self.lock:
            if any(j.status in ("queued", "running") for j in self.jobs.values()):
                raise Busy("a job is running")
            self.jobs[job.id] = job
        worker = threading.Thread(target=self._run, args=(config, job), daemon=True)
        worker.start()
        if self.wait:
            worker.join()
        return job

    def _run(self, config: CrawlConfig, job: Job) -> None:
        job.status, job.started_at = "running", datetime.now(UTC).isoformat()
        try:
            job.summary = self.execute(config, job)
            job.status = "complete"
        except Exception as e:  # noqa: BLE001  the job tells
            job.status, job.error = "error", str(e)
        job.finished_at = datetime.now(UTC).isoformat()
        os.makedirs(job.output_dir, exist_ok=True)
        with open(f"{job.output_dir}/job.json", "w", encoding="utf-8") as f:
            json.dump(job.snapshot(), f)

    def runs(self) -> list[dict]:
        """Runs on disk, the newest first: live ones by their job, others by their files."""
        live = {j.output_dir: j for j in self.jobs.values()}
        out = []
        for name in os.listdir(self.root) if os.path.isdir(self.root) else ():
            at = f"{self.root}/{name}"
            job = live.get(at)
            status = job.status if job else "complete" if os.path.exists(f"{at}/phone_inventory.csv") else "interrupted" if os.path.exists(f"{at}/state") else None
            if status:
                out.append({"id": job.id if job else name, "output_dir": at, "status": status, "start_url": job.start_url if job else None, "mtime": os.path.getmtime(at)})
        return sorted(out, key=lambda r: (-r["mtime"], r["output_dir"]))

    def table(self, spark: SparkSession, job_id: str, name: str, text: str = "") -> list[dict]:
        limit = VIEW_ROWS[name]
        path = f"{self.find(job_id)}/{name}.csv"
        if not os.path.exists(path):
            return []
        df = spark.read.option("header", True).option("escape", '"').csv(path).fillna("")
        df = filter_rows(df, text) if text else df
        return [r.asDict() for r in (df.limit(limit) if limit else df).collect()]

    def find(self, job_id: str) -> str:
        return self.jobs[job_id].output_dir if job_id in self.jobs else self.safe(job_id)

    def file(self, job_id: str, name: str) -> File:
        """One of a run's files; the parts of a table are sent as one."""
        if name not in FILES:
            raise ValueError("no such file")
        path = f"{self.find(job_id)}/{name}"
        parts = sorted(f"{path}/{x}" for x in os.listdir(path) if x.startswith("part-")) if os.path.isdir(path) else [path]
        if not all(os.path.isfile(x) for x in parts):
            raise FileNotFoundError(path)
        return File(name, tuple(parts))


@dataclass(frozen=True)
class File:
    """Paths whose bytes are sent one after the other; of CSV parts the header once."""

    name: str
    parts: tuple[str, ...]

    def chunks(self, size: int = 1 << 20) -> Iterator[bytes]:
        for k, path in enumerate(self.parts):
            with open(path, "rb") as f:
                if k and self.name.endswith(".csv"):
                    f.readline()
                while data := f.read(size):
                    yield data


def execute_with(spark: SparkSession) -> Callable[[CrawlConfig, Job], dict[str, str]]:
    """What a job does: a live run, whose files go to the job's folder and whose progress goes to its log."""

    def execute(config: CrawlConfig, job: Job) -> dict[str, str]:
        from lodestar import progress
        from lodestar.session import run

        with progress.listening(lambda tag, message: job.log(f"[{tag}] {message}")):
            result = run(spark, config, live=True)
            result.export(config.output_dir)
        return {r["metric"]: r["value"] for r in result.summary().orderBy("ord").collect()}

    return execute


#: The dashboard: a form, the run's state, and a table that is read again while the run goes on. All values are escaped.
PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>lodestar</title><style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:left;border-bottom:1px solid #ddd}pre{background:#f4f4f4;padding:8px}</style></head>
<body><h1>Phone inventory</h1><form id="start"><input name="start_url" placeholder="https://example.org" size="40"><button>Start</button></form><p id="state"></p>
<p id="files"></p><nav>TABS</nav><div id="rows"></div><pre id="log"></pre><script>
const clean = v => String(v ?? "").replace(/[&<>"]/g, c => "&#" + c.charCodeAt(0) + ";");
const at = id => document.getElementById(id);
let run = location.hash.slice(1), tab = "inventory";
async function rows() {
  const got = await fetch(`/api/crawls/${run}/${tab}`), list = got.ok ? await got.json() : [], names = Object.keys(list[0] || {});
  at("rows").innerHTML = "<table><tr>" + names.map(n => `<th>${clean(n)}</th>`).join("") + "</tr>" + list.map(r => "<tr>" + names.map(n => `<td>${clean(r[n])}</td>`).join("") + "</tr>").join("") + "</table>";
}
async function poll() {
  if (!run) return;
  const got = await fetch(`/api/crawls/${run}`);
  if (!got.ok) return;
  const job = await got.json(), live = job.status === "running" || job.status === "queued";
  at("state").textContent = `${job.start_url}: ${job.status} ${job.error || ""}`;
  at("log").textContent = (job.logs || []).join("\n");
  at("files").innerHTML = live ? "" : FILES.map(f => `<a href="/api/crawls/${encodeURIComponent(run)}/files/${f}">${f}</a>`).join(" ");
  if (!live) await rows();
  if (live) setTimeout(poll, POLL_MS);
}
at("start").onsubmit = async e => {
  e.preventDefault();
  const got = await fetch("/api/crawls", {method: "POST", body: JSON.stringify(Object.fromEntries(new FormData(e.target)))}), job = await got.json();
  if (!got.ok) { at("state").textContent = job.error; return; }
  location.hash = run = job.id;
  poll();
};
document.querySelectorAll("nav button").forEach(b => b.onclick = () => { tab = b.name; rows(); });
poll();
</script></body></html>"""


def page() -> str:
    from html import escape

    tabs = "".join(f'<button name="{escape(t)}">{escape(t)}</button> ' for t in TABLES)
    return PAGE.replace("TABS", tabs).replace("FILES", json.dumps(FILES), 1).replace("POLL_MS", str(POLL_MS))


TABLES = {"inventory": "phone_inventory", "occurrences": "phone_occurrences", "coverage": "url_inventory", "errors": "crawl_errors"}


def handle(jobs: Jobs, spark: SparkSession | None, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
    """Status and answer of a request: JSON, a File, or the dashboard as text."""
    parts = [p for p in path.partition("?")[0].split("/") if p]
    try:
        if method == "GET" and not parts:
            return 200, page()
        if method == "GET" and parts == ["api", "health"]:
            return 200, {"status": "ok"}
        if method == "GET" and parts == ["api", "runs"]:
            return 200, jobs.runs()
        if method == "POST" and parts == ["api", "crawls"]:
            return 200, jobs.start(body or {}).snapshot()
        if method == "GET" and parts[:2] == ["api", "crawls"] and len(parts) >= 3:
            if len(parts) == 3:
                if parts[2] in jobs.jobs:
                    return 200, jobs.jobs[parts[2]].snapshot()
                with open(f"{jobs.safe(parts[2])}/job.json", encoding="utf-8") as f:
                    return 200, json.load(f)
            if len(parts) == 4 and parts[3] in TABLES:
                return 200, jobs.table(spark, parts[2], TABLES[parts[3]])
            if len(parts) == 5 and parts[3] == "files":
                return 200, jobs.file(parts[2], parts[4])
    except Busy as e:
        return 409, {"error": str(e)}
    except (ValueError, TypeError) as e:
        return 422, {"error": str(e)}
    except OSError:
        pass
    return 404, {"error": "not found"}


def serve(jobs: Jobs, spark: SparkSession | None, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else None
            except ValueError:
                body = None
            status, value = handle(jobs, spark, method, self.path, body)
            self.send_response(status)
            if isinstance(value, File):
                self.send_header("Content-Type", "application/octet-stream")
                self.send_header("Content-Disposition", f'attachment; filename="{value.name}"')
                self.end_headers()
                for chunk in value.chunks():
                    self.wfile.write(chunk)
                return
            data = value.encode() if isinstance(value, str) else json.dumps(value, default=str).encode()
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
