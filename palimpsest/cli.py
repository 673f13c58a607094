"""palimpsest [FLAGS] PATTERN [REV] [PATH...]: searches the history of the repository around the working directory."""

from __future__ import annotations

import signal
import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from palimpsest.options import OptionError, parse_args

VERSION = "0.1"
HELP = """usage: palimpsest [FLAGS] PATTERN [REV] [PATH...] [-- PATH...]
  matching   -e PATTERN  -F literal  -i ignore case  -s respect case  -S smart case  -w whole words  -v invert  -m N lines a file  -a binary as text
  output     -n/-N line numbers  -l files  -c counts  -q quiet  -A/-B/-C N context  --heading/--no-heading  --color WHEN  --unordered
  paths      -g GLOB (! excludes)  -t TYPE
  history    --all  --branch NAME  --first-parent  --since DATE  --until DATE  --author RE  --committer RE  --expand-commits
exit code: 0 matches, 1 none, 2 error, 130 interrupted, 143 terminated"""


class Stop:
    """Which signal has asked the search to stop, if any."""

    number: int | None = None


@contextmanager
def stoppable(cancel: Callable[[], None]) -> Iterator[Stop]:
    """Within, the first SIGINT or SIGTERM cancels jobs, again and again until the search has ended; a second signal ends
    the process at once, as if nothing caught it.

    The main thread is left to find its job cancelled: its connection to the JVM is busy with that job's call. Signals
    are for a program's main thread; in others this does nothing, and callers cancel by tag (see engine.running).
    """
    held, stop, ended = {}, Stop(), threading.Event()

    def cancelling() -> None:
        while not ended.is_set():
            cancel()
            ended.wait(0.2)

    def asked(number, frame) -> None:
        for n in held:
            signal.signal(n, signal.SIG_DFL)
        stop.number = number
        threading.Thread(target=cancelling, daemon=True).start()

    try:
        if threading.current_thread() is threading.main_thread():
            for n in (signal.SIGINT, signal.SIGTERM):
                held[n] = signal.getsignal(n)
                signal.signal(n, asked)
        yield stop
    finally:
        ended.set()
        for n, before in held.items():
            signal.signal(n, before)


def main(args: list[str] | None = None, spark=None, start: str = ".", out=None, err=None, source=None) -> int:
    """Runs one search and returns its exit code; a source that has been read already is searched as it is."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        options = parse_args(sys.argv[1:] if args is None else args).validate()
        if options.help or options.version:
            print(HELP if options.help else VERSION, file=out)
            return 0
        from pyspark.sql import SparkSession

        from palimpsest.plans.engine import running

        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        with running(spark) as cancel, stoppable(cancel) as stop:
            try:
                code = _run(spark, source, start, options, out, err, stop)
            except KeyboardInterrupt:
                cancel()
                stop.number = signal.SIGINT
            except Exception:
                if stop.number is None:
                    raise
            if stop.number is None:
                return code
            print("terminated" if stop.number == signal.SIGTERM else "interrupted", file=err)
            return 128 + stop.number
    except OptionError as e:
        print(f"error: {e}", file=err)
        return 2


def _run(spark, source, start: str, options, out, err, stop: Stop) -> int:
    from palimpsest.plans.engine import first_match, from_git, quiet_code, search
    from palimpsest.sinks.render import use_color
    from palimpsest.sources.gitstore import CorruptObject, NotFound

    try:
        source = source or from_git(spark, start)
        if options.quiet:
            found, skipped, _ = first_match(spark, source, options)
            return quiet_code(found, skipped)
        result = search(spark, source, options)
    except (CorruptObject, NotFound) as e:
        raise OptionError(str(e)) from None
    for line in result.lines(use_color(options.color, out)):
        if stop.number is not None:
            return 2
        print(line, file=out)
    for row in result.skipped.select("blob_oid", "error").toLocalIterator():
        print(f"warning: skipped {row.blob_oid}: {row.error}", file=err)
    return result.exit_code()


if __name__ == "__main__":
    sys.exit(main())
