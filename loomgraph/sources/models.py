"""Models outside the engine as sources of columns: embeddings of texts, inferred relations of skills."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.runtime import parse_topology
from loomgraph.operators.validation import hint_edges
from loomgraph.storage import cut, ship

#: Bytes of text that a model gets at once.
BATCH_BYTES = 1 << 20

Embedder = Callable[[list[str]], np.ndarray]


def hashed(dim: int) -> Embedder:
    """A deterministic stand-in for a model: signed hashed word counts."""
    import re
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h // dim % 2 == 0 else -1
        return out

    return run


#: Functions that load a model in a worker, by name; each takes the dimension and gives a function of a list of texts.
BACKENDS: dict[str, Callable[[int], Embedder]] = {"hashed": hashed}


def by_bytes(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t.encode())
        if k > first and size + n > most:
            yield slice(first, k)
            first, size = k, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


def embed(texts: DataFrame, dim: int, backend: str | Callable[[int], Embedder] = "hashed", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``texts`` (text, ...) with ``vector``: what a backend makes of each text, at length 1.

    ``backend`` names one of ``BACKENDS`` or is such a function; it loads its
    model once a task, and gets whole texts, about ``batch_bytes`` at a time.  A vector of
    another length than ``dim`` ends the job.  Null and empty texts and vectors
    of length 0 give zeros; the result doesn't depend on the batches.
    """
    if isinstance(backend, str) and backend not in BACKENDS:
        raise ValueError(f"no backend {backend!r}: {', '.join(sorted(BACKENDS))}")
    ship(texts.sparkSession)
    load = BACKENDS[backend] if isinstance(backend, str) else backend

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(dim)
        for column in columns:
            rows = [t or "" for t in column.to_pylist()]
            out = np.zeros((len(rows), dim))
            for part in by_bytes(rows, batch_bytes):
                made = np.asarray(model(rows[part]), dtype=np.float64)
                if made.shape != (part.stop - part.start, dim):
                    raise ValueError(f"the backend gave vectors of shape {made.shape}, not {(part.stop - part.start, dim)}")
                norm = np.linalg.norm(made, axis=1, keepdims=True)
                out[part] = np.divide(made, norm, out=np.zeros_like(made), where=norm > 0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.reshape(-1)))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return texts.withColumn("vector", F.arrow_udf(run, "array<double>")("text"))


REPLY = pa.struct([("response", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])


def ask(prompts: DataFrame, call: Callable[[list[str]], list[str]], tries: int = 3, batch: int = 16, pause: float = 1.0) -> DataFrame:
    """``prompts`` (prompt, ...) with (response, error, attempts), whatever the call does.

    ``call`` answers a list of at most ``batch`` prompts.  If it raises, or gives
    another number of answers, its prompts are asked again one by one, each up to
    ``tries`` times with growing pauses; what fails for good has an error instead of a response.
    """
    ship(prompts.sparkSession)

    def one(prompt: str) -> dict:
        for k in range(1, tries + 1):
            try:
                (answer,) = call([prompt])
                return {"response": answer, "error": None, "attempts": k}
            except Exception as e:  # noqa: BLE001  any failure of the service is a row's error
                error = f"{type(e).__name__}: {e}"
                time.sleep(pause * k if k < tries else 0)
        return {"response": None, "error": error, "attempts": tries}

    def run(column: pa.Array) -> pa.Array:
        out, rows = [], [p or "" for p in column.to_pylist()]
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            try:
                answers = call(part)
                if len(answers) != len(part):
                    raise ValueError("another number of answers")
                out += [{"response": a, "error": None, "attempts": 1} for a in answers]
            except Exception:  # noqa: BLE001
                out += map(one, part)
        return pa.array(out, REPLY)

    return prompts.withColumn("reply", F.arrow_udf(run, "struct<response:string,error:string,attempts:int>")("prompt")).select(*prompts.columns, "reply.*")


def infer_relations(skills: DataFrame, call: Callable[[list[str]], list[str]] | None, **how) -> tuple[DataFrame, DataFrame]:
    """(source, target, edge_type, confidence, origin) and (uid, error) for ``skills`` (uid, prompt, hints).

    Relations are those of the responses (see ``parse_topology``), with origin
    ``inferred``.  A skill whose call failed, whose response isn't a JSON map, or all
    skills without a ``call``, fall back to their declared hints with confidence
    1 and origin ``declared``; the second table has why.
    """
    blank = {"response": F.lit(None).cast("string"), "error": F.lit("no model"), "attempts": F.lit(0)}
    rows = cut(ask(skills, call, **how) if call is not None else skills.withColumns(blank))
    whole = F.from_json("response", "struct<topology_map:map<string,string>>")["topology_map"].isNotNull()
    rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(whole, F.lit(False)), "not a topology map"))
    found = parse_topology(rows.where("error is null").select("response")).withColumn("origin", F.lit("inferred"))
    declared = hint_edges(rows.where("error is not null").select("uid", "hints"), "uid", "hints").select("source", "target", "edge_type", F.lit(1.0).alias("confidence"), F.lit("declared").alias("origin"))
    return found.unionByName(declared), rows.where("error is not null").select("uid", "error")
