"""HTTP routes, tools and jobs over the commands; standard library only."""

from __future__ import annotations

import itertools
import json
import re
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame

from strandline.surfaces.commands import COMMANDS, Store, options

#: Rows of a table that an answer shows; it says how many there are.
SHOWN = 500

#: Method, route, command; True: runs as a job.
ROUTES = [
    ("GET", "/api/v1/status", "status", False),
    ("POST", "/api/v1/phenotype/load", "phenotype load", False),
    ("POST", "/api/v1/phenotype/activate", "phenotype activate", False),
    ("POST", "/api/v1/assoc/scan", "assoc scan", True),
    ("GET", "/api/v1/assoc/results/{run_id}", "results show", False),
    ("POST", "/api/v1/epistasis/scan", "epistasis scan", True),
    ("POST", "/api/v1/flow/architecture", "flow architecture", True),
    ("POST", "/api/v1/finemap", "finemap", False),
    ("POST", "/api/v1/mpat", "assoc mpat", False),
    ("POST", "/api/v1/gnn/run", "gnn run", True),
    ("POST", "/api/v1/cypher/query", "sql", False),
    ("POST", "/api/v1/interpret/{run_id}", "interpret", False),
    ("POST", "/api/v1/heritability/spectral", "heritability spectral", False),
    ("POST", "/api/v1/heritability/conductance", "heritability conductance", False),
    ("POST", "/api/v1/heritability/flow", "heritability flow", True),
    ("POST", "/api/v1/heritability/gnn", "heritability gnn", True),
    ("POST", "/api/v1/heritability/report", "heritability report", True),
    ("POST", "/api/v1/multivariate/correlation", "multivariate correlation", False),
    ("POST", "/api/v1/multivariate/g-matrix", "multivariate g-matrix", False),
    ("POST", "/api/v1/multivariate/coherence", "multivariate coherence", False),
    ("POST", "/api/v1/multivariate/pleiotropy", "multivariate pleiotropy", False),
    ("POST", "/api/v1/multivariate/psi", "multivariate psi", False),
    ("POST", "/api/v1/met/load", "met load", False),
    ("GET", "/api/v1/met/status/{trial_id}", "met status", False),
    ("POST", "/api/v1/met/env-similarity", "met env-similarity", False),
    ("POST", "/api/v1/met/mega-environments", "met mega-env", False),
    ("POST", "/api/v1/met/gxe", "met gxe", False),
    ("GET", "/api/v1/met/diagnostics/{trial_id}", "met diagnostics", False),
    ("POST", "/api/v1/met/impute", "met impute", False),
    ("POST", "/api/v1/met/report", "met report", True),
    ("POST", "/api/v1/prs/classical", "prs classical", False),
    ("POST", "/api/v1/prs/graph-pruned", "prs graph-pruned", False),
    ("POST", "/api/v1/prs/pathway", "prs pathway", False),
    ("POST", "/api/v1/prs/report", "prs report", True),
    ("POST", "/api/v1/mr/report", "mr report", True),
]

#: Tool, the commands it chooses among, the argument that chooses.
TOOLS = {
    "run_association_scan": ("assoc scan",),
    "find_epistatic_modules": ("epistasis scan",),
    "extract_disease_architecture": ("flow architecture",),
    "finemap_locus": ("finemap",),
    "run_mpat_gene_test": ("assoc mpat",),
    "query_graph": ("sql",),
    "get_database_status": ("status",),
    "run_spectral_correction": ("spectral correction",),
    "run_gnn_pipeline": ("gnn run",),
    "estimate_heritability": ("heritability spectral", "heritability conductance", "heritability flow", "heritability gnn", "heritability multi", "heritability report"),
    "genetic_correlation": ("multivariate correlation", "multivariate multi-resolution", "multivariate coherence", "multivariate report"),
    "gene_pleiotropy_score": ("multivariate psi",),
    "compute_prs": ("prs classical", "prs graph-pruned", "prs pathway", "prs report"),
    "mendelian_randomization": ("mr report",),
    "analyze_met": ("met gxe", "met env-similarity", "met mega-env", "met diagnostics", "met reaction-norm", "met report", "met status"),
    "impute_missing_met": ("met impute",),
}
#: Names that tools use for options.
ALIASES = {"chromosome": "chr", "cypher_query": "query", "exposure_run_id": "exposure_run", "outcome_run_id": "outcome_run", "sample_id_column": "sample_id_col"}


def plain(x):
    """What JSON can hold: at most SHOWN rows of a table, with their number where there are more."""
    if isinstance(x, DataFrame):
        rows = [json.loads(r) for r in x.limit(SHOWN + 1).toJSON().collect()]
        return rows if len(rows) <= SHOWN else {"rows": rows[:SHOWN], "of": x.count()}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.item() if hasattr(x, "item") else x


def call(s: Store, name: str, given: dict):
    """Runs a command with the options that it knows, converted to their types; unknown or missing ones are an error."""
    known, given = options(COMMANDS[name]), {ALIASES.get(k, k).replace("-", "_"): v for k, v in given.items() if v is not None}
    if odd := set(given) - set(known):
        raise ValueError(f"{name} has no option {', '.join(sorted(odd))}")
    import inspect

    if lacking := [k for k, (_, default) in known.items() if default is inspect.Parameter.empty and k not in given]:
        raise ValueError(f"{name} needs {', '.join(lacking)}")
    made = {k: (str(v).lower() in ("1", "true", "yes")) if known[k][0] is bool else ",".join(map(str, v)) if isinstance(v, list) else known[k][0](v) for k, v in given.items()}
    return COMMANDS[name](s, **made)


class Jobs:
    """Commands that run in threads: id -> state and result."""

    def __init__(self, workers: int = 2):
        self.pool, self.held, self.numbers, self.lock = ThreadPoolExecutor(workers), {}, itertools.count(1), threading.Lock()

    def start(self, name: str, run) -> dict:
        with self.lock:
            key = f"job-{next(self.numbers)}"
            job = self.held[key] = {"job_id": key, "command": name, "status": "pending"}

        def work():
            job["status"] = "running"
            try:
                job.update(result=run(), status="completed")
            except Exception as e:  # told to whoever asks for the job
                job.update(status="failed", error=str(e)[:2000])

        self.pool.submit(work)
        return dict(job)

    def get(self, key: str) -> dict:
        return dict(self.held[key])

    def all(self) -> list[dict]:
        return [{k: v for k, v in j.items() if k != "result"} for j in self.held.values()]


class Api:
    def __init__(self, s: Store):
        self.store, self.jobs = s, Jobs()
        self.routes = [(m, re.compile("^" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", p) + "$"), c, j) for m, p, c, j in ROUTES]

    def answer(self, method: str, path: str, given: dict) -> tuple[int, object]:
        if method == "GET" and path == "/api/v1/jobs":
            return 200, self.jobs.all()
        if method == "GET" and path.startswith("/api/v1/jobs/"):
            key = path.rsplit("/", 1)[1]
            return (200, self.jobs.get(key)) if key in self.jobs.held else (404, {"error": f"no job {key}"})
        for m, pattern, name, job in self.routes:
            if m == method and (hit := pattern.match(path)):
                given = {**given, **hit.groupdict()}
                run = lambda: plain(call(self.store, name, given))  # noqa: B023, E731
                try:
                    return (202, self.jobs.start(name, run)) if job else (200, run())
                except (ValueError, TypeError) as e:
                    return 400, {"error": str(e)}
                except KeyError as e:
                    return 404, {"error": str(e)}
        return 404, {"error": f"no route {method} {path}"}


def serve(s: Store, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server of the routes; the caller runs serve_forever()."""
    api = Api(s)

    class Handler(BaseHTTPRequestHandler):
        def _say(self, method: str):
            url = urlsplit(self.path)
            try:
                size = int(self.headers.get("Content-Length") or 0)
                given = json.loads(self.rfile.read(size)) if size else {}
                code, out = api.answer(method, url.path, {**dict(parse_qsl(url.query)), **given})
            except json.JSONDecodeError as e:
                code, out = 400, {"error": str(e)}
            except Exception as e:  # the server outlives a failed command
                code, out = 500, {"error": str(e)[:2000]}
            raw = json.dumps(out, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802
            self._say("GET")

        def do_POST(self):  # noqa: N802
            self._say("POST")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def tool_list() -> list[dict]:
    kinds = {str: "string", int: "integer", float: "number", bool: "boolean"}
    out = []
    for name, choices in TOOLS.items():
        fields = {k: {"type": kinds[t]} for c in choices for k, (t, _) in options(COMMANDS[c]).items()}
        if len(choices) > 1:
            fields["method"] = {"type": "string", "enum": [c.split(" ", 1)[1] for c in choices]}
        out.append({"name": name, "description": (COMMANDS[choices[0]].__doc__ or f"The command `{choices[0]}`.").strip(), "inputSchema": {"type": "object", "properties": fields}})
    return out


def tool_call(s: Store, name: str, given: dict) -> str:
    choices, given = TOOLS[name], dict(given)
    if len(choices) > 1:
        wanted = str(given.pop("method", None) or choices[0].split(" ", 1)[1]).replace("_", "-")
        chosen = next((c for c in choices if c.split(" ", 1)[1] == wanted), None)
        if chosen is None:
            raise ValueError(f"{name}: method {wanted}")
    else:
        chosen = choices[0]
    return json.dumps(plain(call(s, chosen, given)), default=str)


def tools_over(s: Store, lines=None, out=None) -> None:
    """JSON-RPC over lines: initialize, tools/list, tools/call; notifications get no answer."""
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        asked = json.loads(line)
        if "id" not in asked:
            continue
        said: dict = {"jsonrpc": "2.0", "id": asked["id"]}
        method, given = asked.get("method"), asked.get("params") or {}
        try:
            if method == "initialize":
                said["result"] = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "strandline", "version": "1"}}
            elif method == "tools/list":
                said["result"] = {"tools": tool_list()}
            elif method == "tools/call":
                said["result"] = {"content": [{"type": "text", "text": tool_call(s, given["name"], given.get("arguments") or {})}]}
            else:
                said["error"] = {"code": -32601, "message": f"no method {method}"}
        except Exception as e:  # told to the caller
            said["result"] = {"content": [{"type": "text", "text": str(e)[:2000]}], "isError": True}
        print(json.dumps(said), file=out or sys.stdout, flush=True)
