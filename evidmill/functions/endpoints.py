"""Remote endpoints in argument lists and blob addresses in URIs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The flags that name an endpoint, and hosts that stay readable.
ENDPOINT_FLAGS = ("--remote_cache", "--remote_executor")
EXECUTOR_FLAG = "--remote_executor"
LOOPBACK = ("127.0.0.1", "localhost", "::1")
# Claims that configuration alone can never support.
UNSUPPORTED_CLAIMS = ("worker_identity", "action_placement", "queue_time", "scheduler_assignment", "load_distribution")
# Resource names that are not blob downloads.
RESERVED_SEGMENTS = ("uploads", "operations", "actions")


def fingerprint(endpoint: Column) -> Column:
    return F.substring(F.sha2(endpoint, 256), 1, 16)


def _parts(endpoint: Column) -> dict[str, Column]:
    scheme = F.lower(F.regexp_extract(endpoint, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(endpoint, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    hostport = F.regexp_extract(authority, r"([^@]*)$", 1)
    host = F.lower(
        F.when(hostport.startswith("["), F.regexp_extract(hostport, r"^\[([^\]]*)", 1)).otherwise(
            F.regexp_extract(hostport, r"^([^:]*)", 1)
        )
    )
    port = F.regexp_extract(hostport, r":(\d+)$", 1)
    return {"scheme": scheme, "host": host, "port": port, "credentials": authority.contains("@")}


def endpoint_is_open(endpoint: Column) -> Column:
    """True when the endpoint may be shown: loopback without credentials."""
    p = _parts(endpoint)
    return p["host"].isin(*LOOPBACK) & ~p["credentials"]


def endpoint_label(endpoint: Column) -> Column:
    """F8: the endpoint itself for loopback, else scheme, port and fingerprint."""
    p = _parts(endpoint)
    hidden = F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"))).otherwise(""),
        F.lit("<redacted>"),
        F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""),
        F.lit("#"),
        fingerprint(endpoint),
    )
    return F.when(p["host"].isin(*LOOPBACK) & ~p["credentials"], endpoint).otherwise(hidden)


def remote_endpoints(command: Column, flag: str = EXECUTOR_FLAG) -> Column:
    """Values of ``flag``, joined by ``=`` or as the next argument, in order."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("pending"))

    def step(acc: Column, arg: Column) -> Column:
        joined = arg.startswith(flag + "=")
        add = F.when(acc["pending"], arg).when(joined, F.substr(arg, F.lit(len(flag) + 2)))
        out = F.when(acc["pending"] | joined, F.array_append(acc["out"], add)).otherwise(acc["out"])
        return F.struct(out.alias("out"), (~acc["pending"] & (arg == flag)).alias("pending"))

    return F.aggregate(command, start, step, lambda acc: acc["out"])


def sanitize_args(command: Column) -> Column:
    """The argument list with every endpoint value replaced by its label."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("pending"))

    def step(acc: Column, arg: Column) -> Column:
        flag = F.lit(None).cast("string")
        for name in ENDPOINT_FLAGS:
            flag = F.when(arg.startswith(name + "="), F.lit(name)).otherwise(flag)
        value = F.substr(arg, F.length(flag) + 2)
        new = (
            F.when(acc["pending"], endpoint_label(arg))
            .when(flag.isNotNull(), F.concat(flag, F.lit("="), endpoint_label(value)))
            .otherwise(arg)
        )
        pending = ~acc["pending"] & arg.isin(*ENDPOINT_FLAGS)
        return F.struct(F.array_append(acc["out"], new).alias("out"), pending.alias("pending"))

    return F.aggregate(command, start, step, lambda acc: acc["out"])


def unsupported_claims(worker_seen: Column) -> Column:
    """The fixed claims, less worker identity where it was observed."""
    every = F.array(*[F.lit(c) for c in UNSUPPORTED_CLAIMS])
    return F.when(worker_seen, F.array_except(every, F.array(F.lit("worker_identity")))).otherwise(every)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_blob_uri(uri: Column) -> Column:
    """struct(instance, hash, size, compressed) of a blob address, else NULL."""
    path = F.regexp_extract(uri, r"^(?i:bytestream)://[^/?#]*([^?#]*)", 1)
    decoded = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), decoded)
    # The first reserved segment ends the instance name; a leading slot keeps the position above zero.
    place = lambda s: F.array_position(F.transform(s, lambda x: x.isin("blobs", "compressed-blobs")), F.lit(True)).cast("int")

    def split(both: Column) -> Column:
        seg, at = both["seg"], both["at"]
        packed = F.try_element_at(seg, F.nullif(at, F.lit(0))) == "compressed-blobs"
        return F.struct(
            F.slice(seg, F.lit(1), F.greatest(at - 1, F.lit(0))).alias("instance"),
            F.slice(seg, at + F.when(packed, 2).otherwise(1), F.lit(3)).alias("rest"),
            (F.size(seg) - at - F.when(packed, 1).otherwise(0)).alias("n"),
            packed.alias("packed"), (at > 0).alias("found"),
        )

    def build(p: Column) -> Column:
        digest = F.lower(F.try_element_at(p["rest"], F.lit(1)))
        size = F.trim(F.try_element_at(p["rest"], F.lit(2))).try_cast("bigint")
        clean = ~F.exists(p["instance"], lambda s: s.isin(*RESERVED_SEGMENTS))
        ok = p["found"] & (p["n"] == 2) & digest.rlike("^[0-9a-f]+$") & (size >= 0) & clean
        return F.when(ok, F.struct(
            F.array_join(p["instance"], "/").alias("instance"), digest.alias("hash"), size.alias("size"),
            p["packed"].alias("compressed"),
        ))

    paired = let(segments, lambda s: F.struct(s.alias("seg"), place(s).alias("at")))
    return F.when(path != "", let(let(paired, split), build))
