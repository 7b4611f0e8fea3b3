"""Commands over a store: python -m keyloft.cli ROOT ls | meta A | schema A | keys A | subsets A | parts A SUBSET | batches A | batch A BID | peek A PART | audit A | tree | search A TEXT | dbstat A | optimize A | watch A."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from keyloft.sources.store import Store


def run(store: Store, command: str, *args: str) -> DataFrame | dict | list:
    head = lambda: store.catalog.head(args[0])
    return {
        "ls": store.list_nodes,
        "meta": lambda: store.meta(args[0]).subsets,
        "schema": lambda: head().schema,
        "keys": lambda: head().schema["key_schema"],
        "subsets": lambda: store.list_subsets(*args),
        "parts": lambda: store.list_parts(*args),
        "batches": lambda: store.tail_batches(args[0]),
        "batch": lambda: store.show_batch(*args),
        "peek": lambda: store.peek(*args),
        "audit": lambda: store.audit(args[0]),
        "tree": lambda: {a: store.catalog.head(a).paths for a in store.catalog.aliases()},
        "search": lambda: store.search(*args),
        "dbstat": lambda: store.statistics(args[0]),
        "optimize": lambda: store.optimize(args[0]),
        "watch": lambda: store.catalog.commits(args[0])[-20:],
    }[command]()


def main(argv: list[str]) -> None:
    if len(argv) < 2:
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("keyloft").getOrCreate()
    out = run(Store(spark, argv[0]), *argv[1:])
    out.show(100, truncate=False) if isinstance(out, DataFrame) else print(json.dumps(out, indent=1, default=str))


if __name__ == "__main__":
    main(sys.argv[1:])
