"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from seqloom.sources.adapters import SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers a function of (spark, sf_dir). `uses` names the shapes that the SQL selects from; `sql` may begin with
    further common table expressions in the form `with a as (...) select ...`."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            shapes, body = [SQL[u] for u in uses.split()], sql.strip()
            if shapes and body[:5].lower() == "with ":
                body = "WITH " + ", ".join([*shapes, body[5:]])
            elif shapes:
                body = "WITH " + ", ".join(shapes) + " " + body
            ORACLES[name] = body.replace("WITH ", "WITH RECURSIVE ", 1) if "UNION ALL" in body else body
        return f

    return keep
