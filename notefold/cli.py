"""The command line: ``python -m notefold.cli init|sync|search|status|rebuild``, text or one JSON object."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import asdict, is_dataclass

from notefold import __version__
from notefold.errors import NotefoldError, UsageError
from notefold.functions.shown import duration

SCHEMA = 1


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="notefold", description="Search a folder of notes by meaning and by exact words.")
    top.add_argument("--version", action="version", version=__version__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, text in (("init", "make an index for a folder"), ("sync", "bring the index in step"), ("search", "ask"), ("status", "is the index in step?"), ("rebuild", "make it again"), ("doctor", "does vector search work here?")):
        v = verbs.add_parser(name, help=text)
        v.add_argument("root", help="the folder of notes")
        v.add_argument("--index", required=True, help="the index's folder")
        v.add_argument("--exclude", action="append", default=[], help="a folder or note to leave out; may be repeated")
        v.add_argument("--json", action="store_true", help="one JSON object")
        if name == "sync":
            v.add_argument("--verify", action="store_true", help="hash every note")
            v.add_argument("--allow-mass-delete", action="store_true")
        if name == "search":
            v.add_argument("questions", nargs="+", help="one or several wordings")
            v.add_argument("-k", "--count", type=int)
            v.add_argument("--no-exact-words", action="store_true")
            v.add_argument("--no-sync", action="store_true", help="don't bring a few waiting passages in step first")
            v.add_argument("--vault", help="the name links are made with")
            v.add_argument("--vaults", help="the editor's list of vaults, to find that name in")
        if name == "status":
            v.add_argument("--verify", action="store_true")
        if name == "rebuild":
            v.add_argument("--full", action="store_true")
    return top


def _run(a: argparse.Namespace, spark) -> dict:
    from notefold.index import Index

    index = Index.create(spark, a.root, a.index, exclude=a.exclude, vault=getattr(a, "vault", None), registry=getattr(a, "vaults", None))
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]  # noqa: E731  # at most 50 results
    if a.verb == "init":
        return {"indexDir": os.path.abspath(a.index), "notesFound": index.listing().where("kind = 'note' AND reason IS NULL").count(), "excluded": a.exclude}
    if a.verb == "search":
        if not any(q.strip() for q in a.questions):
            raise UsageError("a question is needed")
        notices: list[str] = []
        if a.no_sync:
            meaning, exact = index.search(a.questions, a.count, not a.no_exact_words)
        else:
            answer = index.ask(a.questions, a.count, not a.no_exact_words)
            meaning, exact, notices = answer.meaning, answer.exact, answer.notices
        return {"queries": a.questions, "notices": notices, "results": sorted(rows(meaning), key=lambda r: r["rank"]), "exactWords": sorted(rows(exact), key=lambda r: r["rank"]) if exact is not None else []}
    if a.verb == "doctor":
        from notefold.operators.selftest import round_trip

        vectors = index.store.read("vectors").selectExpr("row_number() OVER (ORDER BY path, n) AS vec_id", "vector AS embedding").limit(1_000)
        return {"checks": rows(round_trip(spark, vectors, dims=index.make().dimensions))}
    if a.verb == "status":
        checks = rows(index.status(a.verify))
        return {"inStep": all(c["ok"] for c in checks), "checks": checks}
    out = index.sync(a.verify, a.allow_mass_delete) if a.verb == "sync" else index.rebuild(a.full)
    return asdict(out) if is_dataclass(out) else vars(out)


def _text(verb: str, body: dict) -> str:
    if verb == "search":
        show = lambda r: f"{r['note']} › {r.get('section', '')}   match {r['score']}\n{r['path']}:{r.get('line', '')}  {r.get('link') or ''}\n{r['snippet']}\n"
        return "\n".join([*body["notices"], *map(show, body["results"])]) + ("\nExact words:\n" + "\n".join(map(show, body["exactWords"])) if body["exactWords"] else "")
    if verb in ("status", "doctor"):
        return "\n".join(f"{'ok ' if c['ok'] else 'NO '} {c['name']}" for c in body["checks"])
    return "\n".join(f"{k}: {v}" for k, v in body.items() if k != "tables")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    began = time.time()
    spark = SparkSession.builder.appName("notefold").getOrCreate()
    try:
        body = _run(a, spark)
    except NotefoldError as e:
        error = {"code": type(e).__name__, "message": str(e), "exitCode": e.exit_code}
        print(json.dumps({"schema": SCHEMA, "ok": False, "command": a.verb, "version": __version__, "error": error}) if a.json else f"{error['code']}: {error['message']}", file=sys.stdout if a.json else sys.stderr)
        return e.exit_code
    if a.json:
        print(json.dumps({"schema": SCHEMA, "ok": True, "command": a.verb, "version": __version__, "tookMs": round((time.time() - began) * 1000), **body}))
    else:
        print(_text(a.verb, body))
        print(f"took {duration((time.time() - began) * 1000)}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
