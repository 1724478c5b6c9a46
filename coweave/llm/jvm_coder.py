"""The coder of token blocks as two functions of columns, run by the executors' JVMs.

``TokenCoder.java`` beside this file is compiled in memory by Janino, the compiler that Spark itself ships for generated code,
and handed to the executors as a jar. So no Java toolchain and no built artefact is needed.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from importlib.resources import files
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CLASS = "coweave.TokenCoder"


def _loaded(spark: SparkSession):
    """The compiled class, once for each Spark context."""
    sc = spark.sparkContext
    if not hasattr(sc, "_coweave_coder"):
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(files(__package__).joinpath("TokenCoder.java").read_text())
        made = compiler.getBytecodes()
        at = Path(tempfile.mkdtemp(prefix="coweave-")) / f"coweave-coder-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(at, "w") as z:
            for name in sorted(made.keySet()):
                z.writestr(f"{name.replace('.', '/')}.class", bytes(made.get(name)))
        sc._jsc.addJar(str(at))  # the driver serves it to the executors
        sc._coweave_coder = compiler.getClassLoader().loadClass(_CLASS)
    return sc._coweave_coder


def _register(spark: SparkSession, name: str, packs: bool) -> None:
    made = spark.sparkContext._gateway.new_array(spark._jvm.Object, 1)
    made[0] = packs
    function = _loaded(spark).getConstructors()[0].newInstance(made)
    spark._jsparkSession.udf().register(name, function, spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)


def pack(spark: SparkSession, ids: Column, block: int) -> Column:
    """The segment of ids (little-endian unsigned 32-bit integers) in blocks of ``block``."""
    _register(spark, "coweave_pack_ids", True)
    return F.call_function("coweave_pack_ids", ids, F.lit(block))


def unpack(spark: SparkSession, segment: Column, block: int = -1) -> Column:
    """The ids of a segment, or of one of its blocks only. A block that fails its checksum raises an error."""
    _register(spark, "coweave_unpack_ids", False)
    return F.call_function("coweave_unpack_ids", segment, F.lit(block))
