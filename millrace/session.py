"""Sessions and what executors need of this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Rows of an Arrow batch, where the application doesn't say: whole texts are large rows, and a batch is
#: held on both sides of a worker's pipe.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that Python workers can import it.

    Also bounds Arrow batches in the session, unless the application has set them.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_KEY) and spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("millrace")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
