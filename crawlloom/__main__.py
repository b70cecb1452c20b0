"""Commands: new, update, export, status, sites. Pages come from a recorded fetch log (Parquet)."""

from __future__ import annotations

import argparse
import logging
import signal
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .operators.robots import Robots
from .operators.sitemap import SitemapError
from .plans.project import Project, Run, SiteError
from .sources.config import Config, ConfigError

VERSION = "1.1"
log = logging.getLogger("crawlloom")

#: Settings that a command's options put over the file's: option, setting, how it is read.
_SETTINGS = (
    ("--delay", "delay", {"type": float}), ("--max-pages", "max_pages", {"type": int}), ("--max-depth", "max_depth", {"type": int}), ("--max-attempts", "max_attempts", {"type": int}),
    ("--max-runtime", "max_runtime", {"type": float}), ("--ignore-robots", "respect_robots", {"action": "store_false"}), ("--ignore-canonical", "respect_canonical", {"action": "store_false"}),
    ("--no-headless", "headless", {"action": "store_false"}), ("--wait-for", "wait_for_selector", {}),
)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="crawlloom", description=__doc__)
    parser.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("new", "update", "export", "status", "sites"):
        own = commands.add_parser(name)
        own.add_argument("-c", "--config", help="a JSON file of settings")
        own.add_argument("--url", help="the base URL")
        own.add_argument("--site", help="a stored site's name")
        own.add_argument("--sites-dir")
        loud = own.add_mutually_exclusive_group()
        loud.add_argument("-v", "--verbose", action="store_true", help="tell more")
        loud.add_argument("-q", "--quiet", action="store_true", help="tell only what is wrong")
        if name in ("new", "update"):
            own.add_argument("--log", required=True, help="the fetch log: url, attempt, final_url, links, canonical, fault, retryable, message")
            own.add_argument("--robots", help="a robots.txt file")
            own.add_argument("--round-pages", type=int, help="store what is done after each so many pages; an interrupt then ends the crawl after the round at hand")
            for option, setting, how in _SETTINGS:
                own.add_argument(option, dest=setting, default=None, **how)
        if name == "new":
            own.add_argument("-y", "--yes", action="store_true", help="discard what is stored of the site without asking")
            own.add_argument("--force", action="store_true", help="overwrite even another site's pages")
        if name == "export":
            own.add_argument("--output", default="sitemap.xml")
            own.add_argument("--lastmod", default="none")
            own.add_argument("--allow-empty", action="store_true", help="write a sitemap even of no pages")
    return parser


def configure_logging(verbose: bool = False, quiet: bool = False) -> None:
    """Messages go to the standard error; calling it again changes the level and adds nothing."""
    for old in list(log.handlers):
        log.removeHandler(old)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(levelname)s: %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.DEBUG if verbose else logging.WARNING if quiet else logging.INFO)
    log.propagate = False


@contextmanager
def stoppable() -> Iterator[list[bool]]:
    """A list that gets an entry at the first interrupt; the second one raises as usual."""
    asked: list[bool] = []

    def once(number: int, frame: object) -> None:
        asked.append(True)
        signal.signal(signal.SIGINT, signal.default_int_handler)
        log.warning("interrupted: the round at hand is finished and stored; once more stops at once")

    try:
        before = signal.signal(signal.SIGINT, once)
    except ValueError:  # not the main thread: nothing to listen to
        yield asked
        return
    try:
        yield asked
    finally:
        signal.signal(signal.SIGINT, before)


def _may_discard(project: Project, config: Config, args: argparse.Namespace) -> bool:
    """Whether what is stored may go: nothing is, or -y, or nobody is there to be asked who could have meant otherwise."""
    site, n = project.known(config, args.site)
    if not n or args.yes:
        return True
    if not sys.stdin.isatty():
        raise SiteError(f"{site} is stored already ({n} URLs); -y discards it, `update` goes on with it")
    return input(f"{site} holds {n} URLs already. Discard them? [y/N] ").strip().lower() in ("y", "yes")


def _describe(run: Run, seconds: float) -> str:
    return f"{run.site}: {run.counts}, {run.stop_reason}, {seconds:.1f} s"


def _crawl(project: Project, config: Config, args: argparse.Namespace, spark: SparkSession) -> int:
    robots, began = None, time.monotonic()
    if args.robots:
        with open(args.robots, encoding="utf-8", errors="replace") as f:
            robots = Robots.parse(f.read(), config.user_agent)
    if args.command == "new" and not _may_discard(project, config, args):
        log.info("nothing is changed; `update` goes on with what is stored")
        return 0
    pages = spark.read.parquet(args.log)
    how = {"round_pages": args.round_pages}
    if args.round_pages is None:
        run = _started(project, config, args, pages, robots, how)
    else:
        with stoppable() as asked:
            run = _started(project, config, args, pages, robots, how | {"stop": lambda: bool(asked)})
    print("nothing is left to do" if run is None else _describe(run, time.monotonic() - began))
    return 0 if run is None else run.exit_code


def _started(project: Project, config: Config, args: argparse.Namespace, pages, robots: Robots | None, how: dict) -> Run | None:
    if args.command == "new":
        return project.new(config, pages, robots, args.site, discard=True, force=args.force, **how)
    return project.update(config, pages, robots, args.site, **how)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: a crawl that didn't end well, or nothing to export; 2: settings that can't be used; 130: interrupted."""
    args = _parser().parse_args(argv)
    configure_logging(args.verbose, args.quiet)
    try:
        settings = {k: getattr(args, k, None) for k in ("sites_dir", *(s for _, s, _ in _SETTINGS))}
        config = Config.load(args.config, base_url=args.url, **settings)
        spark = spark or SparkSession.builder.appName("crawlloom").getOrCreate()
        project = Project(spark, config.sites_dir)
        if args.command in ("new", "update"):
            return _crawl(project, config, args, spark)
        if args.command == "export":
            done = project.export(config, args.output, args.site, args.lastmod, args.allow_empty)
            print(f"{done.url_count} URLs in {len(done.files)} file(s)" + (f", index {done.index}" if done.index else ""))
        elif args.command == "status":
            print(project.status(config, args.site))
        else:
            for r in project.sites().toLocalIterator():
                print(f"{r['site']}  done {r['done']}  queued {r['queued']}")
        return 0
    except (ConfigError, SiteError) as e:
        log.error("%s", e)
        return 2
    except SitemapError as e:
        log.error("%s", e)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
