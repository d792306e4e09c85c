"""The prediction model in a Java process beside this one, some hundred times as fast as Python's: machines that run Spark have Java.

Its source is ``Ppmd.java``, which ``java`` compiles as it starts. Where that can't be done (no compiler, no file), there is no helper,
and Python's model does the work. The process ends when this one does, as its input ends.
"""

from __future__ import annotations

import itertools
import os
import shutil
import struct
import subprocess
import threading
from pathlib import Path

SOURCE = Path(__file__).with_name("Ppmd.java")
#: Megabytes of the helper's heap, and the largest arena of a model that it takes.
HEAP, ARENA = 384, 16 << 20
FINE, DAMAGED, FULL, ENDED = range(4)


class Helper:
    def __init__(self) -> None:
        home = os.environ.get("JAVA_HOME")
        java = (home and shutil.which(f"{home}/bin/java")) or shutil.which("java")
        if java is None or not SOURCE.is_file():
            raise OSError("no Java, or no source")
        command = [java, "-Xms24m", "-Xmn16m", f"-Xmx{HEAP}m", "-XX:+UseSerialGC", "-XX:-UsePerfData", str(SOURCE)]
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.lock, self.ids, self.gone = threading.Lock(), itertools.count(), []
        if self.process.stdout.read(1) != b"P":
            self.process.wait()
            raise OSError("no compiler")

    def read(self, n: int) -> bytes:
        got = self.process.stdout.read(n)
        if len(got) != n:
            raise RuntimeError("the prediction model's process has ended")
        return got

    def ask(self, what: bytes, number: int, args: bytes = b"", answer: str = "", tail: bool = False) -> tuple:
        """``answer``: the layout of what comes back; ``tail``: so many bytes as its last number says come after it."""
        with self.lock:
            while self.gone:  # models are dropped at any time, also within an exchange
                self.process.stdin.write(struct.pack(">ci", b"F", self.gone.pop()))
            self.process.stdin.write(struct.pack(">ci", what, number) + args)
            if not answer:
                return ()
            self.process.stdin.flush()
            found = struct.unpack(answer, self.read(struct.calcsize(answer)))
            return (*found, self.read(found[-1])) if tail else found


_helper: tuple[int, Helper | None] | None = None
_starting = threading.Lock()


def helper() -> Helper | None:
    """This process's own, if there is Java."""
    global _helper
    with _starting:
        if _helper is None or _helper[0] != os.getpid():
            try:
                _helper = os.getpid(), Helper()
            except OSError:
                _helper = os.getpid(), None
        return _helper[1]


class Model:
    """A model in the helper; statuses are those of ``Ppmd.java``."""

    def __init__(self, to: Helper, order: int, text: int, units: float):
        self.to, self.number = to, next(to.ids)
        to.ask(b"N", self.number, struct.pack(">iqd", order, text, units))

    def __del__(self) -> None:
        self.to.gone.append(self.number)

    def give(self, raw: bytes, at: int, anew: bool) -> tuple[int, int]:
        """The bytes to read, from ``at`` on; if ``anew`` the coder starts there. Status and place."""
        return self.to.ask(b"S", self.number, struct.pack(">?ii", anew, at, len(raw)) + raw, ">bi" if anew else "") or (FINE, at)

    def read(self, most: int, mark: int) -> tuple[int, int, bool, bytes]:
        """So many symbols at most, up to a ``mark`` (-1: none): status, place, whether the mark was read, symbols."""
        status, at, marked, _, out = self.to.ask(b"R", self.number, struct.pack(">ii", most, mark), ">bi?i", tail=True)
        return status, at, marked, out

    def write(self, symbols: bytes) -> tuple[int, bytes]:
        status, _, out = self.to.ask(b"W", self.number, struct.pack(">i", len(symbols)) + symbols, ">bi", tail=True)
        return status, out
