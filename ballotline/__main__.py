"""python -m ballotline build REFERENCES MCC_RISK OUT [LEAF_SIZE]
python -m ballotline score INDEX BODIES OUT

build: an index from a JSON array of references (gzipped or not) and a JSON object of risks.
score: decisions, as Parquet, for a text file with a JSON body on each line; qid is the line's number in Spark's order.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .constants import LEAF_SIZE
from .operators.tables import Written
from .plans import scoring
from .sources.index import read_index


def main(args: list[str]) -> int:
    if len(args) not in (4, 5) or args[0] not in ("build", "score") or (args[0] == "score" and len(args) == 5):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("ballotline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "build":
        scoring.build(spark, args[1], args[2], args[3], int(args[4]) if len(args) == 5 else LEAF_SIZE)
    else:
        index, risk = read_index(spark, args[1])
        # written first, so that the numbers stay what they are
        bodies = Written(spark.read.text(args[2]).select(F.monotonically_increasing_id().alias("qid"), F.col("value").alias("body")), "bodies").df
        scoring.score(bodies, index, risk).write.parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
