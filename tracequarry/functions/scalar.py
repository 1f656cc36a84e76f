"""Numbers, hashes, vectors, classes and step predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.functions.text import col, strip

# fixed values: phrases by which an environment says that an action failed
FAILED_A = ("nothing happens", "i don't understand", "you can't", "not possible", "invalid")
FAILED_C = ("i don't understand", "invalid", "nothing happens", "you can't", "not possible", "unknown action")
IDLE_A = ("look", "inventory")
IDLE_C = ("look", "look around", "inventory")
FAILED_CODE = (
    "execution failed. traceback:",
    "execution timed out",
    "syntax error in line",
    "no code available to execute",
    "maximum number of executions",
)
RETRY_CODES = (408, 409, 429)
RETRY_TEXT = ("upstream_error", "upstream request failed", "bad gateway")
CATEGORIES = ("improved", "regressed", "persistent_fail", "stable_success")
# fixed values: what a transport error says while a retry may help
TRANSIENT = (
    "connection reset by peer",
    "connection aborted",
    "connection refused",
    "remoteappworld call",
    "remote appworld call",
    "read timed out",
    "max retries exceeded",
    "network is unreachable",
    "status=429",
    "http 429",
    "upstream load",
    "上游负载已饱和",
    "ssl eof",
    "eof occurred in violation of protocol",
    "empty completion content",
    "http 502",
    "http 503",
    "http 504",
)


def fixed(value: Column, places: int = 2) -> Column:
    """A double with that many places (up to 4) as C and Python print it: its exact binary value is rounded, a tie to even.

    Java's own format rounds the shortest decimal up instead: 0.145, which is less than its name, to 0.15. The value
    is split in two halves whose products with a power of ten are exact. From 1e10 on Java's format stands. Null stays.
    """
    scale = 10**places
    x = value.cast("double")
    size = F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    below = F.floor(size * scale)
    over = (high * (2.0 * scale) - (2 * below + 1)) + (size - high) * (2.0 * scale)
    n = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    digits = F.concat(sign, F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))
    return F.when(size < 1e10, digits).when(x.isNotNull(), F.format_string(f"%.{places}f", x))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def bad_step(before: Column | str, after: Column | str, action: Column | str, phrases=FAILED_A, idle=IDLE_A) -> Column:
    """A failure phrase in what came back, or nothing changed by an action that should change something."""
    before, after = (strip(F.coalesce(col(x), F.lit(""))) for x in (before, after))
    action = F.coalesce(col(action), F.lit(""))
    return any_of(F.lower(after), phrases) | ((before == after) & ~action.isin(*idle))


def execution_failed(code: Column | str, output: Column | str) -> Column:
    return (strip(F.coalesce(col(code), F.lit(""))) == "") | any_of(F.lower(F.coalesce(col(output), F.lit(""))), FAILED_CODE)


def transient_error(message: Column | str) -> Column:
    return any_of(F.lower(F.coalesce(col(message), F.lit(""))), TRANSIENT)


def retryable(status: Column | str, message: Column | str) -> Column:
    status = col(status)
    text = F.lower(F.coalesce(col(message), F.lit("")))
    return F.coalesce(status.isin(*RETRY_CODES) | status.between(500, 599), F.lit(False)) | any_of(
        text, RETRY_TEXT
    )


def score_0_1(value: Column | str) -> Column:
    """Number in 0..1: bad ones are 0, those over 1 are percentages."""
    x = F.coalesce(col(value).cast("string").try_cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x), 0.0).otherwise(x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x)))


def outcome(before: Column, after: Column) -> Column:
    """improved, regressed, persistent_fail or stable_success; a missing side has not succeeded."""
    a, b = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return F.when(~a & b, "improved").when(a & ~b, "regressed").when(~a & ~b, "persistent_fail").otherwise("stable_success")


def sha(text: Column | str) -> Column:
    return F.sha2(F.coalesce(col(text), F.lit("")), 256)


def cache_key(model: Column | str, text: Column | str) -> Column:
    return F.concat(col(model), F.lit(":"), sha(text))


def replay_key(document: Column, edit: list[Column], evidence: Column, index: Column, trigger: list[Column]) -> Column:
    """Identity of a replay: fields in a fixed order, nulls kept apart from ''."""
    fields = [sha(document), *edit, evidence, index, *trigger]
    marked = [F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("~")) for f in fields]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


def short_sha1(text: Column | str) -> Column:
    return F.substring(F.sha1(col(text)), 1, 10)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """Vector of length 1; one without length stays as it is."""
    a = F.transform(col(a), lambda x: x.cast("double"))
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def last_n(a: Column, n: int) -> Column:
    """Last elements; all of a shorter array, none for n = 0."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) if n > 0 else F.slice(a, 1, 0)


def rotated(a: Column, by: Column | int) -> Column:
    """The array from position ``by`` on, then what came before."""
    by = F.lit(by) if isinstance(by, int) else by
    at = F.when(F.size(a) > 0, F.pmod(by, F.size(a))).otherwise(F.lit(0))
    return F.concat(F.slice(a, at + 1, F.size(a)), F.slice(a, F.lit(1), at))


def backoff(attempt: Column, initial: float, most: float, jitter: Column | None = None) -> Column:
    """Seconds to wait: doubled per attempt, exponent at most 30, within a fifth either way."""
    wait = F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(0)), F.lit(30))))
    return wait * (0.8 + 0.4 * (jitter if jitter is not None else F.rand()))


def bundle_index(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("int")


def test_report(success: Column, num_tests: Column, passes: Column, failures: Column) -> Column:
    """(success, tests, passed, failed): failures are never fewer than the tests that didn't pass."""
    passed, failed = F.coalesce(F.size(passes), F.lit(0)), F.coalesce(F.size(failures), F.lit(0))
    passed, failed = F.greatest(passed, F.lit(0)), F.greatest(failed, F.lit(0))
    total = F.coalesce(num_tests, F.lit(0))
    failed = F.greatest(failed, total - passed)
    good = F.coalesce(success, F.lit(False)) & (total > 0) & (passed == total)
    return F.struct(good.alias("success"), total.alias("num_tests"), passed.alias("passed"), failed.alias("failed"))


def episode_success(flag: Column, score: Column, full: float = 1.0) -> Column:
    """Whether an episode ended well: its flag, or where it has none, a score of ``full`` or more; never null."""
    return F.coalesce(flag, score >= full, F.lit(False))
