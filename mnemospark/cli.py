"""Command line: python -m mnemospark.cli --store FOLDER {search,profile,stats,status,backfill,wipe} ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from mnemospark.config import Config
from mnemospark.sources.store import Store
from mnemospark.tools import Memory


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run one command and return what it prints."""
    p = argparse.ArgumentParser(prog="mnemospark")
    p.add_argument("--store", required=True)
    p.add_argument("--now", type=int, default=None, help="epoch milliseconds; the clock's if not given")
    c = p.add_subparsers(dest="command", required=True)
    s = c.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int)
    c.add_parser("profile").add_argument("--rebuild", action="store_true")
    c.add_parser("stats")
    c.add_parser("status")
    c.add_parser("wipe").add_argument("--confirm", action="store_true")
    a = p.parse_args(argv)
    m = Memory(Store(spark or SparkSession.builder.getOrCreate(), a.store), Config())
    now = int(time.time() * 1000) if a.now is None else a.now
    if a.command == "search":
        out = m.search_text(a.query, a.limit)
    elif a.command == "profile":
        if a.rebuild:
            m.store.commit(profile_cache=m.store.read("profile_cache").limit(0))
        rows = m.profile(now).orderBy("profile_type", "position").collect()
        part = lambda kind: [f"  - {r['text']}" for r in rows if r["profile_type"] == kind] or ["  (none)"]
        out = "\n".join(["Long-term:", *part("longTerm"), "Recent:", *part("recent")])
    elif a.command == "wipe":
        if a.confirm:
            m.store.wipe()
        out = "The store is empty." if a.confirm else "Nothing done: --confirm is needed to remove all memories."
    else:
        st = m.status()
        out = "\n".join(f"{k}: {v}" for k, v in st.items() if a.command == "status" or isinstance(v, int))
    print(out)
    return out


if __name__ == "__main__":
    main()
