"""A prompt over a store: python -m tidemark ROOT. For trying things out; a command is a Spark job."""

import sys

from tidemark.session import session
from tidemark.store import Store


def main() -> None:
    spark = session()
    store = Store(spark, sys.argv[1])
    for line in iter(lambda: input("> "), "exit"):
        for r in store.execute(spark.createDataFrame([(0, line)], "id long, line string")).collect():
            print(r["reply"])


if __name__ == "__main__":
    main()
