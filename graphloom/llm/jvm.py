"""The model's inner loops in Spark's own JVM: lm.java, compiled by the compiler that Spark brings for its generated code.

Nothing else has to be installed. Where the driver's JVM has no vectors of 16 numbers (its CPU, its modules, or a
session without a JVM of its own), `kernel` gives None and lm.py runs its numpy functions.
"""

from __future__ import annotations

import os
import pkgutil
import re
import zipfile

import numpy as np
from pyspark.sql import DataFrame

_BUILT: dict[str, object] = {}


def source(constants: dict[str, int]) -> str:
    """lm.java with its constants, and its repeated lines and parts written out."""
    text = pkgutil.get_data("graphloom.llm", "lm.java").decode()
    text = re.sub(r"//STRIDES\n(.*?)//END\n", lambda m: "".join(re.sub(r"ST\b", str(n), re.sub(r"\bSK\b", "16" if n == 1 else "1", m[1])) for n in (1, 16, 32)), text, flags=re.S)
    text = re.sub(r"^ *EACH (.*)$", lambda m: "\n".join(m[1].replace("@", str(t)) for t in range(16)), text, flags=re.M)
    text = re.sub(r"^ *SOME (.*)$", lambda m: "\n".join(m[1].replace("@", str(t)).replace("%", str(t % 4)) for t in range(16) if t not in (1, 2, 3)), text, flags=re.M)
    return text.replace("//CONSTANTS", "".join(f"static final int {k} = {v};" for k, v in constants.items()))


def _built(spark, constants: dict[str, int]):
    """The compiled class, which executors get as a jar; None where it would not run well."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or not jvm.java.lang.ModuleLayer.boot().findModule("jdk.incubator.vector").isPresent():
        return None
    sc = spark.sparkContext
    key = f"{sc.applicationId} {constants}"
    if key not in _BUILT:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source(constants))
        cls = compiler.getClassLoader().loadClass("LmKernel")
        if _new(sc, cls).lanes() < 16:
            cls = None
        else:
            codes = compiler.getBytecodes()
            jar = os.path.join(sc._temp_dir, "lm_kernel.jar")
            with zipfile.ZipFile(jar, "w") as z:
                for name in codes:
                    z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
            sc._jsc.addJar(jar)
        _BUILT.clear()
        _BUILT[key] = cls
    return _BUILT[key]


def _new(sc, cls):
    none = lambda kind: sc._gateway.new_array(kind, 0)
    return cls.getDeclaredConstructor(none(sc._jvm.java.lang.Class)).newInstance(none(sc._jvm.java.lang.Object))


def kernel(df: DataFrame, constants: dict[str, int], model: bytes, training: bool, schema: str) -> DataFrame | None:
    """What the kernel makes of df's partitions."""
    spark = df.sparkSession
    cls = _built(spark, constants)
    if cls is None:
        return None
    made, jvm = _new(spark.sparkContext, cls), spark._jvm
    made.set(model, training)
    rows = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(schema))
    return DataFrame(df._jdf.mapPartitions(made, rows), spark)


def packed(seed: int, rate: float, sizes: list[int], floats: list[np.ndarray], ints: list[np.ndarray], more: list[np.ndarray]) -> bytes:
    """A model as lm.java reads it, with the state from which numpy permutes by the seed."""
    state = np.random.PCG64(seed).state["state"]
    words = [state["state"] >> 64, state["state"] & (2**64 - 1), state["inc"] >> 64, state["inc"] & (2**64 - 1)]
    parts = [np.array(words, "<u8"), np.array([rate], "<f8"), np.array(sizes, "<i4"), *(np.asarray(a, "<f4") for a in floats), *(np.asarray(a, "<i4") for a in ints), *(np.asarray(a, "<f4") for a in more)]
    return b"".join(a.tobytes() for a in parts)
