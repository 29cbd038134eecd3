"""Command line. Exit codes: 0 fine, 1 gate failed, 2 bad input, 5 too large.

A folder alone is the drift gate. `--artifacts-dir` keeps what `--json` prints as report.json, with error.json on failure.
"""

from __future__ import annotations

import argparse
import io
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from weirflow import session
from weirflow.operators import dialects, drift, flow, history, lineage, parse, plugins, report, rewrite, security, sessions
from weirflow.sources import files
from weirflow.sources.store import Store

VERSION = "0.2.0"
MOST_STAGES = 10_000
COMMANDS = ("parse", "inspect", "lineage", "drift", "diff", "scan", "rewrite", "plan", "approve", "dry-run", "apply", "verify", "restore", "session", "history", "audit", "kpi", "export")
_SEVERITIES = ["low", "medium", "high", "critical"]


class Refused(Exception):
    """A hard error: exit code, a code word and what to say."""

    def __init__(self, code: int, word: str, message: str):
        super().__init__(message)
        self.code, self.word = code, word


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weirflow")
    top.add_argument("--version", action="version", version=f"weirflow {VERSION}")
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        one = sub.add_parser(name)
        one.add_argument("root")
        one.add_argument("--store")
        one.add_argument("--no-persist", action="store_true", help="write nothing to the store")
        one.add_argument("--json", action="store_true")
        one.add_argument("--artifacts-dir")
        one.add_argument("--max-stages", type=int, default=MOST_STAGES)
        if name in ("drift", "diff"):
            one.add_argument("--threshold", type=float, default=drift.THRESHOLD)
            one.add_argument("--markdown", action="store_true")
        if name == "scan":
            one.add_argument("--severity", default="low", choices=_SEVERITIES)
            one.add_argument("--fail-on-severity", default="high", choices=["none", *_SEVERITIES])
            one.add_argument("--max-findings", type=int, default=security.MOST_FINDINGS)
            one.add_argument("--max-bytes", type=int, default=files.MOST_BYTES)
        if name in ("plan", "approve", "dry-run", "apply", "verify", "restore", "session"):
            one.add_argument("--session", required=True)
        if name in ("plan", "dry-run", "apply"):
            one.add_argument("--plan", default="plan.json")
        if name == "verify":
            one.add_argument("--fail-on-severity", default="medium", choices=_SEVERITIES)
        if name == "audit":
            one.add_argument("--session")
            one.add_argument("--limit", type=int, default=100)
            one.add_argument("--since", help="hours ago, or a date and time")
        if name in ("apply", "rewrite", "export"):
            one.add_argument("--out", required=name == "export")
        if name in ("rewrite", "plan", "verify"):
            one.add_argument("--rules", nargs="*")
            one.add_argument("--max-risk", default="suggested", choices=list(rewrite.TIERS))
            one.add_argument("--rules-dir")
            one.add_argument("--allow-on-finding", action="store_true")
    return top


class Printer:
    """Says what a command found: rows as text, or one JSON artifact, which the artifact folder keeps as well."""

    def __init__(self, args: argparse.Namespace):
        self.args = args

    def rows(self, df) -> None:
        for row in df.toLocalIterator():
            print(*row, sep="\t")

    def show(self, kind: str, head: dict, lists: dict, text: str | None = None) -> None:
        if self.args.json or self.args.artifacts_dir:
            out = io.StringIO()
            report.artifact(out, kind, {"root": self.args.root, "checked_at": report.checked_at(), "git_sha": report.repo_id(self.args.root)} | head, lists)
            self.keep(out.getvalue(), kind, head.get("run_id") or head.get("session_id"))
            if self.args.json:
                print(out.getvalue(), end="")
                return
        if text is not None:
            print(text)
        else:
            for df in lists.values():
                self.rows(df)

    def keep(self, body: str, kind: str, number: object = None) -> None:
        if not self.args.artifacts_dir:
            return
        folder = Path(self.args.artifacts_dir)
        folder.mkdir(parents=True, exist_ok=True)
        for name in ["report.json", *([f"{kind}-{number}.json"] if number else [])]:
            (folder / name).write_text(body, encoding="utf-8")


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        if not Path(argv[0]).is_dir():
            print(f"error: usage: unknown command {argv[0]!r}", file=sys.stderr)
            return 2
        argv.insert(0, "drift")
    held: list = []

    def keep(df):
        held.append(df.cache())
        return held[-1]

    args = _arguments().parse_args(argv)
    try:
        return _run(args, keep)
    except Refused as error:
        print(f"error: {error.word}: {error}", file=sys.stderr)
        if args.artifacts_dir:
            folder = Path(args.artifacts_dir)
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "error.json").write_text(json.dumps({"schema": "weirflow.error.v1", "version": 1, "code": error.word, "exit": error.code, "message": str(error)}) + "\n", encoding="utf-8")
        return error.code
    finally:
        for df in held:
            df.unpersist()


def _store_command(args, spark, store, say) -> int:
    if args.command == "history":
        say.show("history", {}, {"runs": (store or Store(spark, args.root)).recent_runs()})
    elif args.command == "audit":
        since = None
        if args.since:
            since = F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(args.since))) if args.since.isdigit() else F.to_timestamp(F.lit(args.since))
        say.show("audit", {"session": args.session}, {"entries": store.audit_log(args.session, args.limit, since).orderBy("audit_id")})
    elif args.command == "session":
        plan = flow.known_hash(store, args.session)
        lists = {"audit": store.audit_log(args.session).orderBy("audit_id")}
        if plan:
            lists["items"] = flow.item_states(store, plan).orderBy("state")
        state = sessions.state(store, args.session)
        print(f"session={args.session} state={state} plan={plan or '-'}", file=sys.stderr)
        say.show("session", {"session_id": args.session, "state": state, "plan_hash": plan}, lists)
    elif args.command == "kpi":
        say.show("kpi", {}, {"figures": history.kpis(store.read("runs"), store.read("scans"), store.read("drifts"))})
    else:
        store.migrate()
        store.export(args.out)
    return 0


def _scan(args, spark, store, say, keep) -> int:
    small, large = files.scan_corpus(spark, args.root, args.max_bytes)
    found = keep(security.scan(small))
    if found.limit(args.max_findings).count() >= args.max_findings:
        raise Refused(5, "resource_limit", f"reached --max-findings {args.max_findings}")
    shown = keep(security.at_least(found, args.severity))
    failed = bool(security.gate(shown, args.fail_on_severity).first().failed)
    run = None
    if store:
        run = store.next_run()
        store.append("scans", found.withColumn("run_id", F.lit(run)))
    for row in large.toLocalIterator():
        print(f"skipped {row.path}: {row.length} bytes", file=sys.stderr)
    counts = security.histogram(shown).first().asDict()
    head = {"run_id": run, "severity": args.severity, "fail_on_severity": args.fail_on_severity, "gate": "failed" if failed else "passed", "counts": counts}
    say.show("scan", head, {"findings": shown.orderBy("path", "rule_id", "line", "col")})
    print(f"findings={sum(counts.values()) - counts['suppressed']} suppressed={counts['suppressed']} gate={head['gate']}", file=sys.stderr)
    return int(failed)


def _rewriting(args, spark, store, say, keep, stages) -> int:
    rules = plugins.load(args.rules_dir, lambda m: print(m, file=sys.stderr)) if args.rules_dir else None
    named = lineage.one_per_name(stages).select("path", "name", "raw", F.transform("columns", lambda c: c["name"]).alias("columns"))
    scanned = security.scan(files.scan_corpus(spark, args.root)[0])
    if args.command == "verify":
        problems = keep(rewrite.verify(named, scanned, args.fail_on_severity, args.rules, args.max_risk))
        clean = flow.verify(store, args.session, problems)
        counts = {r.problem: r["count"] for r in problems.groupBy("problem").count().collect()}
        codes = [word for kind, word in (("candidate", "remaining_candidates"), ("finding", "security_regression")) if counts.get(kind)]
        head = {"session_id": args.session, "plan_hash": flow.known_hash(store, args.session), "reparse": {"ok": True, "diagnostics": []}, "remaining_candidates": counts.get("candidate", 0), "result": "verified" if clean else "failed", "failures": codes}
        say.show("verify", head, {"problems": problems})
        return int(not clean)
    found = rewrite.disjoint(rewrite.candidates(named, args.rules, args.max_risk, rules))
    items = keep(rewrite.plan(rewrite.overlay(found, scanned, args.allow_on_finding)))
    n = items.count()
    if n > rewrite.MOST_CANDIDATES:
        raise Refused(5, "resource_limit", f"{n} candidates, more than {rewrite.MOST_CANDIDATES}")
    print_of = parse.pipeline_fingerprint(stages).first().fingerprint
    head = {"fingerprint": print_of, "max_risk": args.max_risk}
    if args.command == "plan":
        try:
            head["plan_hash"] = flow.plan(store, args.session, items, args.root, print_of, args.max_risk, args.plan)
        except sessions.TransitionError as error:
            raise Refused(2, "state_error", str(error)) from error
    say.show("plan" if args.command == "plan" else "analysis", head, {"items": items.drop("item_hash").orderBy("ordinal")})
    if args.command == "plan":
        print(head["plan_hash"])
    elif args.out:
        for row in flow.sound(rewrite.apply(stages, items.where("not blocked"))).where("status = 'applied'").toLocalIterator():
            target = Path(args.out) / row.path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row.rewritten, encoding="utf-8")
    return int(items.where("not blocked").isEmpty() and n > 0)


def _dry_run(args, spark, store, say, keep) -> int:
    items, digest = rewrite.read_plan(spark, args.plan)
    if digest != flow.known_hash(store, args.session):
        raise Refused(2, "plan_error", "the plan is not the session's")
    shown = keep(flow.dry_run(files.project(spark, args.root), items))
    counts = {r.status: r["count"] for r in shown.groupBy("status").count().collect()}
    say.show("dryrun", {"session_id": args.session, "plan_hash": digest, "summary": {k: counts.get(k, 0) for k in ("will_apply", "noop", "blocked", "errors")}}, {"items": shown}, "\n".join(r["diff"] for r in shown.select("path", "diff").distinct().orderBy("path").toLocalIterator()))
    if args.artifacts_dir:
        folder = Path(args.artifacts_dir) / "diffs"
        folder.mkdir(parents=True, exist_ok=True)
        for row in shown.where("diff <> ''").select("path", "diff").distinct().toLocalIterator():
            (folder / (row.path.replace("/", "-") + ".diff")).write_text(row["diff"], encoding="utf-8")
    return 0


def _graph(args, spark, store, say, keep, stages, n: int) -> int:
    refs = stages.select(F.col("name").alias("consumer"), F.posexplode("refs").alias("ordinal", "r")).select("consumer", "ordinal", "r.name", "r.kind")
    srcs = stages.select(F.col("name").alias("consumer"), F.explode("sources").alias("s")).select("consumer", "s.source", "s.table")
    edges, missing = (keep(x) for x in lineage.build(refs, srcs, stages.select("name"), files.source_catalog(spark, args.root)))
    one = F.lit(1).cast("long").alias("run_id")
    names = edges.select(F.col("producer").alias("node")).union(edges.select("consumer")).union(stages.select("name")).distinct()
    nodes = names.select(one, "node", F.col("node").alias("ordinal"))
    walks = keep(lineage.cycles(edges.select(one, "producer", "consumer"), nodes))
    if args.command == "lineage":
        order = lineage.order(edges.select(one, "producer", "consumer"), nodes).orderBy("place").select("node")
        shown = {"edges": edges.select("producer", "consumer", "kind").orderBy("producer", "consumer"), "cycles": walks.orderBy("place").select("walk"), "missing": missing.orderBy("consumer", "ref"), "order": order}
        if args.json or args.artifacts_dir:
            say.show("lineage", {"fingerprint": parse.pipeline_fingerprint(stages).first().fingerprint}, shown)
        if not args.json:
            for title, df in shown.items():
                print(f"# {title}")
                say.rows(df if title != "cycles" else df.select(F.array_join("walk", " -> ")))
        return 0
    if not 0 <= args.threshold <= 1:
        raise Refused(2, "usage", "--threshold is between 0 and 1")
    schemas = lineage.one_per_name(stages).select("name", F.transform("columns", lambda c: c["name"]).alias("columns"))
    drifts = keep(drift.detect(edges, schemas, args.threshold))
    breaking, found = drifts.where("breaking").count(), drifts.count()
    if args.command == "diff":
        diffs = drift.unified_diff(drifts).orderBy("producer", "consumer")
        say.show("diff", {"threshold": args.threshold}, {"diffs": diffs.select("producer", "consumer", "diff")}, "".join(r["diff"] for r in diffs.toLocalIterator()))
        return int(breaking > 0)
    run = None
    if store:
        run = store.next_run()
        store.append("runs", spark.range(1).select(F.lit(run).alias("run_id"), F.lit(args.root).alias("root"), F.current_timestamp().alias("checked_at"), F.lit(n).alias("stages"), F.lit(found).alias("drifts"), F.lit(breaking).alias("breaking")))
        store.append("stages", stages.select(F.lit(run).alias("run_id"), "name", "path", F.transform("refs", lambda r: r["name"]).alias("refs"), F.transform("columns", lambda c: c["name"]).alias("columns")))
        store.append("lineage_edges", edges.withColumn("run_id", F.lit(run)))
        store.append("drifts", drifts.withColumn("run_id", F.lit(run)))
    head = {"run_id": run, "fingerprint": parse.pipeline_fingerprint(stages).first().fingerprint, "threshold": args.threshold, "gate": "failed" if breaking else "passed", "counts": report.summary(stages, edges, missing, drifts).first().asDict()}
    text = report.markdown(stages, edges, missing, drifts, walks).first()[0] if args.markdown else report.text(stages, edges, missing, drifts).first()[0]
    say.show("drift", head, {"drifts": drifts.orderBy("producer", "consumer"), "missing": missing.orderBy("consumer", "ref")}, text)
    return int(breaking > 0)


def _run(args: argparse.Namespace, keep) -> int:
    if not Path(args.root).is_dir():
        raise Refused(2, "no_input", f"{args.root} is not a folder")
    spark = session.create()
    needs_store = args.command in ("plan", "approve", "dry-run", "apply", "verify", "restore", "session", "audit", "kpi", "export")
    if needs_store and (not args.store or args.no_persist):
        raise Refused(2, "state_error", f"{args.command} needs --store, and to write to it")
    store = Store(spark, args.store) if args.store and not args.no_persist else None
    say = Printer(args)
    if args.command in ("history", "audit", "session", "kpi", "export"):
        return _store_command(args, spark, store, say)
    if args.command in ("approve", "apply", "dry-run", "restore"):
        try:
            if args.command == "approve":
                flow.approve(store, args.session)
            elif args.command == "restore":
                print(*flow.restore(store, args.session, args.root), sep="\n")
            elif args.command == "dry-run":
                return _dry_run(args, spark, store, say, keep)
            else:
                done = flow.apply(store, args.session, files.project(spark, args.root), args.root, args.plan, args.out)
                say.show("apply", {"session_id": args.session, "plan_hash": flow.known_hash(store, args.session)}, {"files": done.orderBy("path")})
        except (ValueError, OSError, sessions.TransitionError) as error:
            raise Refused(2, "state_error", str(error)) from error
        return 0
    if args.command == "scan":
        return _scan(args, spark, store, say, keep)
    project = keep(files.project(spark, args.root))
    n = project.count()
    if n == 0:
        raise Refused(2, "no_input", "no *.sql files")
    if n > args.max_stages:
        raise Refused(5, "resource_limit", f"{n} stages, more than --max-stages {args.max_stages}")
    problems = keep(dialects.diagnostics(project))
    errors = problems.where("kind = 'error'")
    if not errors.isEmpty():
        say.rows(errors.orderBy("path"))
        raise Refused(2, "parse_error", "some files do not parse")
    stages = keep(dialects.stages(project))
    if args.command in ("parse", "inspect"):
        shown = stages.drop("raw").orderBy("path")
        if args.command == "inspect":
            spans = parse.projection_columns(project).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", "byte_start", "byte_end", "star"))).alias("spans"))
            shown = stages.drop("raw").join(spans, "path", "left").orderBy("path")
        head = {"v": 1, "fingerprint": parse.pipeline_fingerprint(stages).first().fingerprint}
        say.show(args.command, head, {"stages": shown, "diagnostics": problems.orderBy("path", "reason")})
        return 0
    if args.command in ("rewrite", "plan", "verify"):
        return _rewriting(args, spark, store, say, keep, stages)
    return _graph(args, spark, store, say, keep, stages, n)


if __name__ == "__main__":
    sys.exit(main())
