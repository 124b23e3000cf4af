"""Command line: phone inventory of a site from a fetch log."""

from __future__ import annotations

import argparse
import os

from lodestar.config import CrawlConfig, default_output_dir


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description="Phone inventory and crawl coverage of a site, from a table of fetched pages.")
    p.add_argument("start_url")
    p.add_argument("--fetch-log", help="Parquet table of fetched pages; without it pages are fetched")
    p.add_argument("--sitemaps", dest="sitemap_files", help="Parquet table of sitemap files (sitemap_url, content)")
    p.add_argument("--robots", help="robots file")
    p.add_argument("--rendered", help="Parquet table of rendered pages (url, html)")
    p.add_argument("--output", "-o", help="folder of the results; by default one named after the host and the time")
    p.add_argument("--country", default="US")
    for name in ("max-pages", "max-pdfs", "max-depth", "concurrency", "max-file-size"):
        p.add_argument(f"--{name}", type=int, default=getattr(CrawlConfig, name.replace("-", "_")))
    p.add_argument("--timeout", type=float, default=CrawlConfig.timeout)
    p.add_argument("--delay", type=float, default=CrawlConfig.delay)
    p.add_argument("--include-pdfs", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--discover-sitemaps", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--respect-robots", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--render-js", choices=("off", "auto", "always"), default="auto")
    p.add_argument("--allow-subdomains", action="store_true")
    p.add_argument("--include-url", action="append", default=[])
    p.add_argument("--exclude-url", action="append", default=[], help="added to the default patterns")
    p.add_argument("--user-agent", default=CrawlConfig.user_agent)
    p.add_argument("--classify-ai", action="store_true")
    p.add_argument("--resume", action="store_true", help="don't fetch again what the output of an earlier run holds")
    p.add_argument("--debug", action="store_true")
    return p


def config_of(a: argparse.Namespace) -> CrawlConfig:
    same = ("start_url", "country", "max_pages", "max_pdfs", "max_depth", "concurrency", "timeout", "delay", "include_pdfs", "discover_sitemaps", "respect_robots", "render_js", "allow_subdomains", "user_agent", "max_file_size", "classify_ai", "resume", "debug")
    return CrawlConfig(output_dir=a.output or default_output_dir(a.start_url), include_url_patterns=tuple(a.include_url), exclude_url_patterns=(*CrawlConfig.exclude_url_patterns, *a.exclude_url), **{k: getattr(a, k) for k in same})


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = config_of(a)
    from pyspark.sql import SparkSession

    from lodestar import progress
    from lodestar.ask import chat
    from lodestar.session import run, visited_of
    from lodestar.sources.sinks import Checkpoint

    os.makedirs(config.output_dir, exist_ok=True)
    progress.setup_logging(config.debug, f"{config.output_dir}/crawl.log")
    spark = SparkSession.builder.appName("lodestar").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        read = lambda at: spark.read.parquet(at) if at else None
        robots = "\n".join(r.value for r in spark.read.text(a.robots).collect()) if a.robots else None
        state = Checkpoint(spark, f"{config.output_dir}/state")
        log, live = read(a.fetch_log), not a.fetch_log
        visited = state.load("visited") if config.resume and not live else None
        if live and config.resume and (log := state.load("fetched")) is not None:
            progress.announce("RESUME", f"{log.count()} answers of an earlier run")
        result = run(spark, config, log, read(a.sitemap_files), robots, read(a.rendered), visited, chat() if config.classify_ai else None, live, state if live else None)
        paths = result.export(config.output_dir)
        state.save(max(state.levels(), default=-1) + 1, visited=visited_of(result.pages), occurrences=result.occurrences.drop("seq"))
        for name, path in paths.items():
            print(f"{name}: {path}")
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
