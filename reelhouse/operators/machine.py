"""Video and job state machines over tables.

Two forms:
- snapshot: one command per entity, decided by a join with the current row and an
  ordered ``when`` chain that yields the first failing rule (the reject code);
- replay: many ordered commands per entity. A command is a transition *function* over the
  machine's states, encoded as a struct of scalars per start state s (4-5 states):
      n<s>  next state              a<s>  1 if accepted (sums under composition)
      e<s>  rejection text or NULL  r_<reg>_<s>  value written to register reg
  Composition is CASE lookups on these fields (no arrays are built per step).
  Functions compose associatively, so ``fold.ordered_fold`` replays them as a bounded
  fan-in tree; the final state is the composed function applied to the initial state.

Composite use cases (start / complete / fail a job, upload, archive) run as batches: per
video, the first command (in batch order) that passes every rule wins; later commands for
the same video are judged against the state that winner left behind, as sequential
processing would. "First per video" is an aggregate joined back, never a window, so a hot
video is combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import blank, first_error
from ..session import bounded_broadcast, checkpoint_cut
from .fold import ordered_fold
from .joins import join_back, request_left_join, with_exists_flag
from .integrity import user_error, video_error


@dataclass
class Machine:
    """A finite state machine: ``moves[cmd] = {from_state: to_state}``; a command applied
    in a state it has no move for is rejected with ``errors[cmd]``. ``writes[cmd]`` names
    the register an accepted command writes (its value comes from a payload column)."""
    states: list[str]
    moves: dict[str, dict[str, str]]
    errors: dict[str, str]
    writes: dict[str, str] = field(default_factory=dict)
    unknown_error: str = "unknown command"

    @property
    def registers(self) -> list[str]:
        return sorted(set(self.writes.values()))

    def index(self, state: Column) -> Column:
        """State name -> its index in ``states``."""
        out = None
        for i, st in enumerate(self.states):
            out = F.when(state == st, F.lit(i)) if out is None else out.when(state == st, F.lit(i))
        return out

    # The expressions below are generated as Spark SQL text and parsed once (F.expr): the same
    # Catalyst expressions as the Column API would build, without hundreds of Py4J calls.
    # A transition function is a struct of scalars, one group per start state s:
    #   n<s> next state, a<s> accepted (0/1, summed), e<s> rejection text, r_<reg>_<s> register write.
    def _struct_sql(self, n: list[str], a: list[str], e: list[str], regs: dict[str, list[str]]) -> str:
        k = len(self.states)
        parts = [f"'n{s}', {n[s]}" for s in range(k)] + [f"'a{s}', {a[s]}" for s in range(k)] + \
                [f"'e{s}', {e[s]}" for s in range(k)]
        for r in self.registers:
            parts += [f"'r_{r}_{s}', {regs[r][s]}" for s in range(k)]
        return "named_struct(" + ", ".join(parts) + ")"

    def element_sql(self, cmd: str, payload: dict[str, str] | None = None) -> str:
        """One command (SQL expression ``cmd``) as a transition function."""
        payload = payload or {}
        k = len(self.states)
        n, a, e = [], [], []
        regs: dict[str, list[str]] = {r: [] for r in self.registers}
        for i, st in enumerate(self.states):
            nw, aw, ew = [], [], []
            rw: dict[str, list[str]] = {r: [] for r in self.registers}
            for c, mv in self.moves.items():
                ok = st in mv
                nw.append(f"WHEN {_q(c)} THEN {self.states.index(mv[st]) if ok else i}")
                aw.append(f"WHEN {_q(c)} THEN {1 if ok else 0}")
                ew.append(f"WHEN {_q(c)} THEN " + ("CAST(NULL AS STRING)" if ok else _q(self.errors[c])))
                for r in self.registers:
                    val = f"CAST({payload[r]} AS STRING)" if (ok and self.writes.get(c) == r) else "CAST(NULL AS STRING)"
                    rw[r].append(f"WHEN {_q(c)} THEN {val}")
            n.append(f"CASE {cmd} {' '.join(nw)} ELSE {i} END")
            a.append(f"CAST(CASE {cmd} {' '.join(aw)} ELSE 0 END AS BIGINT)")
            e.append(f"CASE {cmd} {' '.join(ew)} ELSE {_q(self.unknown_error)} END")
            for r in self.registers:
                regs[r].append(f"CASE {cmd} {' '.join(rw[r])} ELSE CAST(NULL AS STRING) END")
        assert len(n) == k
        return self._struct_sql(n, a, e, regs)

    def element(self, cmd: Column | str, payload: dict[str, str] | None = None) -> Column:
        """Column form of ``element_sql``; ``cmd`` and payload values are column names."""
        name = cmd if isinstance(cmd, str) else None
        if name is None:
            raise TypeError("pass the command column by name")
        return F.expr(self.element_sql(f"`{name}`", {r: f"`{c}`" for r, c in (payload or {}).items()}))

    def identity_sql(self) -> str:
        k = len(self.states)
        null_s = "CAST(NULL AS STRING)"
        return self._struct_sql([str(i) for i in range(k)], ["CAST(0 AS BIGINT)"] * k, [null_s] * k,
                                {r: [null_s] * k for r in self.registers})

    @staticmethod
    def _pick_sql(values: list[str], idx: str) -> str:
        return f"CASE {idx} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    def compose_sql(self, a: str, b: str) -> str:
        """a then b, pointwise over start states: (b . a); ``a`` and ``b`` are SQL expressions."""
        k = len(self.states)
        bn = [f"{b}.n{s}" for s in range(k)]
        ba = [f"{b}.a{s}" for s in range(k)]
        be = [f"{b}.e{s}" for s in range(k)]
        n, acc, err = [], [], []
        regs: dict[str, list[str]] = {r: [] for r in self.registers}
        for s in range(k):
            mid = f"{a}.n{s}"
            n.append(self._pick_sql(bn, mid))
            acc.append(f"{a}.a{s} + {self._pick_sql(ba, mid)}")
            err.append(f"coalesce({self._pick_sql(be, mid)}, {a}.e{s})")
            for r in self.registers:
                br = [f"{b}.r_{r}_{t}" for t in range(k)]
                regs[r].append(f"coalesce({self._pick_sql(br, mid)}, {a}.r_{r}_{s})")
        return self._struct_sql(n, acc, err, regs)

    def at_sql(self, t: str, prefix: str, idx: str) -> str:
        """Field ``prefix`` of transition ``t`` for start state index ``idx``."""
        return self._pick_sql([f"{t}.{prefix}{s}" for s in range(len(self.states))], idx)

    # -- replay
    def replay(self, cmds: DataFrame, key: str, seq: str, cmd: str, payload: dict[str, str] | None = None,
               initial: DataFrame | None = None, initial_state: str | None = None,
               branching: int = 1024, missing_error: str = S.ERR_JOB_NOT_FOUND) -> DataFrame:
        """Final state per entity after its commands in ``seq`` order.

        The start state is ``initial_state`` for every entity, or the ``status`` column of
        ``initial`` (key, status, <registers>) joined on the key; entities missing from
        ``initial`` are reported with found = false and no state.
        Output: key, found, status, n_commands, n_accepted, n_rejected, last_error, registers.
        """
        elems = cmds.select(F.col(key), F.col(seq), self.element(cmd, payload).alias("_t"))
        folded = ordered_fold(elems, [key], seq, "_t", self.compose_sql, self.identity_sql(), branching)
        if initial is None:
            base = folded.select("*", F.lit(initial_state).alias("_s0"), F.lit(True).alias("found"))
            reg0 = {r: "CAST(NULL AS STRING)" for r in self.registers}
        else:
            init = initial.select(F.col(key), F.col("status").alias("_s0"),
                                  *[F.col(r).alias(f"_r0_{r}") for r in self.registers], F.lit(True).alias("found"))
            base = folded.join(init, key, "left")
            reg0 = {r: f"_r0_{r}" for r in self.registers}
        i0 = "CASE _s0 " + " ".join(f"WHEN {_q(st)} THEN {i}" for i, st in enumerate(self.states)) + " END"
        ok = "coalesce(found, false)"
        nacc = f"CASE WHEN {ok} THEN {self.at_sql('_t', 'a', i0)} ELSE CAST(0 AS BIGINT) END"
        names = "array(" + ", ".join(_q(st) for st in self.states) + ")"
        missing = _q(missing_error) if initial is not None else "CAST(NULL AS STRING)"
        out = [F.col(key), F.expr(ok).alias("found"),
               F.expr(f"CASE WHEN {ok} THEN element_at({names}, {self.at_sql('_t', 'n', i0)} + 1) END").alias("status"),
               F.col("n").alias("n_commands"), F.expr(nacc).alias("n_accepted"),
               F.expr(f"n - ({nacc})").alias("n_rejected"),
               F.expr(f"CASE WHEN {ok} THEN {self.at_sql('_t', 'e', i0)} ELSE {missing} END").alias("last_error")]
        out += [F.expr(f"CASE WHEN {ok} THEN coalesce({self.at_sql('_t', f'r_{r}_', i0)}, {reg0[r]}) END").alias(r)
                for r in self.registers]
        return base.select(*out)


def _q(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Guarded:
    """A command of a ``GuardedMachine``.

    ``rules`` are (states or None, payload condition or None, rejection text), checked in order: a
    rule with states rejects the command there, one with a condition (SQL over the payload columns)
    where that holds, one with both where both do. ``moves`` maps a state to the next one, under the
    SQL condition ``when`` if given; unnamed states stay. ``register`` gives
    for a register the SQL of what an accepted command writes there."""
    rules: list[tuple[list[str] | None, str | None, str]] = field(default_factory=list)
    moves: dict[str, str] = field(default_factory=dict)
    when: str | None = None
    register: dict[str, str] = field(default_factory=dict)


@dataclass
class GuardedMachine(Machine):
    """A machine whose commands may also be rejected for their payload, or for what an earlier one
    wrote (a flag of a register is part of the state, e.g. duration set or not).

    A command is still one transition function over the states, as its payload is known when it is
    built; so composition, and with it the replay as a tree, stay as they are."""
    commands: dict[str, Guarded] = field(default_factory=dict)

    @property
    def registers(self) -> list[str]:
        return sorted({r for c in self.commands.values() for r in c.register})

    def element_sql(self, cmd: str, payload: dict[str, str] | None = None) -> str:
        null_s = "CAST(NULL AS STRING)"
        n, a, e, regs = [], [], [], {r: [] for r in self.registers}
        for i, st in enumerate(self.states):
            err, nxt, reg = [], [], {r: [] for r in self.registers}
            for name, c in self.commands.items():
                broken = [(cond or "true", text) for states, cond, text in c.rules if states is None or st in states]
                whens = "".join(f" WHEN {cond} THEN {_q(text)}" for cond, text in broken)
                err.append(f"WHEN {_q(name)} THEN " + (f"CASE{whens} END" if broken else null_s))
                to = self.states.index(c.moves.get(st, st))
                nxt.append(f"WHEN {_q(name)} THEN " + (f"CASE WHEN {c.when} THEN {to} ELSE {i} END" if c.when else str(to)))
                for r in self.registers:
                    reg[r].append(f"WHEN {_q(name)} THEN " + (f"CAST({c.register[r]} AS STRING)" if r in c.register else null_s))
            error = f"(CASE {cmd} {' '.join(err)} ELSE {_q(self.unknown_error)} END)"
            n.append(f"CASE WHEN {error} IS NULL THEN CASE {cmd} {' '.join(nxt)} END ELSE {i} END")
            a.append(f"CAST(CASE WHEN {error} IS NULL THEN 1 ELSE 0 END AS BIGINT)")
            e.append(error)
            for r in self.registers:
                regs[r].append(f"CASE WHEN {error} IS NULL THEN CASE {cmd} {' '.join(reg[r])} END END")
        return self._struct_sql(n, a, e, regs)


# FIXED VALUES: the two machines' legal moves (from the domain rules).
VIDEO_MACHINE = Machine(
    states=S.VIDEO_STATUSES,
    moves={
        "process": {"pending": "processing", "failed": "processing"},
        "publish": {"processing": "published"},
        "fail": {"processing": "failed"},
        "archive": {"published": "archived"},
        "update": {s: s for s in S.VIDEO_STATUSES},
    },
    errors={"process": S.ERR_VIDEO_CANNOT_PROCESS, "publish": S.ERR_VIDEO_CANNOT_PUBLISH,
            "fail": S.ERR_VIDEO_CANNOT_FAIL, "archive": S.ERR_VIDEO_CANNOT_ARCHIVE, "update": ""},
)

JOB_MACHINE = Machine(
    states=S.JOB_STATUSES,
    moves={
        "start": {"pending": "running", "failed": "running"},
        "complete": {"running": "completed"},
        "fail": {"running": "failed"},
    },
    errors={"start": S.ERR_JOB_CANNOT_START, "complete": S.ERR_JOB_CANNOT_COMPLETE, "fail": S.ERR_JOB_CANNOT_FAIL},
    writes={"complete": "result", "fail": "error_msg"},
)



#: A video record: its status, and whether its duration is set (``+``), which can happen once.
_SET = "+"
_UNSET, _ALL_SET = list(S.VIDEO_STATUSES), [st + _SET for st in S.VIDEO_STATUSES]


def _from(moves: dict[str, str], error: str) -> Guarded:
    """A status move, the same whether the duration is set or not."""
    both = {**moves, **{a + _SET: b + _SET for a, b in moves.items()}}
    return Guarded([([st for st in _UNSET + _ALL_SET if st not in both], None, error)], both)


VIDEO_RECORD_MACHINE = GuardedMachine(
    states=_UNSET + _ALL_SET, moves={}, errors={},
    commands={
        **{c: _from(VIDEO_MACHINE.moves[c], VIDEO_MACHINE.errors[c]) for c in ("process", "publish", "fail", "archive")},
        "set_title": Guarded([(None, "coalesce(text, '') = ''", S.ERR_TITLE_EMPTY)], register={"title": "text"}),
        "set_description": Guarded([(None, "coalesce(text, '') = ''", S.ERR_DESCRIPTION_EMPTY)], register={"description": "text"}),
        "set_duration": Guarded([(_ALL_SET, None, S.ERR_DURATION_SET), (None, "duration < 0", S.ERR_DURATION_NEGATIVE)],
                                dict(zip(_UNSET, _ALL_SET)), "coalesce(duration, 0) <> 0", {"duration": "coalesce(duration, 0)"}),
    })


def replay_video_edits(edits: DataFrame, videos: DataFrame, branching: int = 1024) -> DataFrame:
    """Replay of status moves and guarded edits (video_id, seq, cmd, text, duration): a title or
    description must not be empty or null (X6), a duration not negative and not set before (X7; null
    counts as 0, and 0 leaves it unset).

    Per video with edits: video_id, found, status, title, description, duration, n_commands, n_accepted,
    n_rejected, last_error. ``seq`` orders the edits of a video and must be distinct there."""
    start = videos.select(F.col("id").alias("video_id"), "title", "description", F.col("duration").cast("string").alias("duration"),
                          F.when(F.col("duration") != 0, F.concat("status", F.lit(_SET))).otherwise(F.col("status")).alias("status"))
    out = VIDEO_RECORD_MACHINE.replay(edits, "video_id", "seq", "cmd", initial=start, branching=branching,
                                      missing_error=S.ERR_VIDEO_NOT_FOUND)
    return out.select("video_id", "found", F.rtrim(F.col("status"), F.lit(_SET)).alias("status"), "title", "description",
                      F.col("duration").cast("long").alias("duration"), "n_commands", "n_accepted", "n_rejected", "last_error")


# ---------------------------------------------------------------- snapshot batches
def _first_per_key(df: DataFrame, key: str, order: list[str], eligible: Column) -> DataFrame:
    """Flag ``_winner`` on the first eligible row per key (order by ``order``, distinct in a
    batch), ``_after_winner`` on later ones and ``_winner_again`` on those of the winner's own job."""
    cand = df.filter(eligible).groupBy(key).agg(F.min(F.struct(*order)).alias("_w"))
    cand = cand.select(key, *[F.col(f"_w.{c}").alias(f"_w_{c}") for c in order])
    j = join_back(df, cand, key, "left")
    same = None
    for c in order:
        e = F.col(c) == F.col(f"_w_{c}")
        same = e if same is None else same & e
    # guard: a struct compared with an all-NULL struct is ordered, not NULL
    after = F.when(F.col(f"_w_{order[0]}").isNotNull(),
                   F.struct(*[F.col(c) for c in order]) > F.struct(*[F.col(f"_w_{c}") for c in order]))
    again = after & (F.col("job_id") == F.col("_w_job_id")) if "job_id" in order else F.lit(False)
    return j.select(*df.columns, F.coalesce(same, F.lit(False)).alias("_winner"),
                    F.coalesce(after, F.lit(False)).alias("_after_winner"),
                    F.coalesce(again, F.lit(False)).alias("_winner_again"))


def start_jobs(batch: DataFrame, jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """X14 over a dispatch batch (job_id, seq): job rule (X9) first, then the video lookup
    (J4), then the video rule (X2). Accepted rows carry the transcode input (F8)."""
    j = jobs.select(F.col("id").alias("job_id"), "video_id", F.col("status").alias("job_status"))
    v = videos.select(F.col("id").alias("video_id"), F.col("status").alias("video_status"), "resource_id",
                      F.col("filename").alias("source_filename"), F.lit(True).alias("_vfound"))
    b = request_left_join(request_left_join(batch.select("job_id", "seq"), j, "job_id"), v, "video_id")
    job_ok = F.col("job_status").isin(S.JOB_PENDING, S.JOB_FAILED)
    found = F.coalesce(F.col("_vfound"), F.lit(False))
    eligible = F.coalesce(job_ok, F.lit(False)) & found & F.col("video_status").isin(S.VIDEO_PENDING, S.VIDEO_FAILED)
    b = _first_per_key(b, "video_id", ["seq", "job_id"], eligible)
    # after the winner the video is 'processing'
    vstat = F.when(F.col("_after_winner"), F.lit(S.VIDEO_PROCESSING)).otherwise(F.col("video_status"))
    err = first_error(
        (F.col("job_status").isNull(), S.ERR_JOB_NOT_FOUND),
        (~job_ok | F.col("_winner_again"), S.ERR_JOB_CANNOT_START),
        (~found, S.ERR_VIDEO_NOT_FOUND),
        (~vstat.isin(S.VIDEO_PENDING, S.VIDEO_FAILED), S.ERR_VIDEO_CANNOT_PROCESS),
    )
    acc = F.col("_winner")
    return b.select("seq", "job_id", "video_id", acc.alias("accepted"), F.when(~acc, err).alias("error"),
                    F.when(acc, S.JOB_RUNNING).otherwise(F.col("job_status")).alias("job_status"),
                    F.when(acc, S.VIDEO_PROCESSING).otherwise(F.col("video_status")).alias("video_status"),
                    F.when(acc, F.col("resource_id")).alias("resource_id"),
                    F.when(acc, F.col("source_filename")).alias("source_filename"))


def complete_jobs(batch: DataFrame, jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """X15 over (seq, job_id, result, duration): job must be running (X10), video found
    (J4), duration not yet set and not negative (X7), video processing -> published (X3)."""
    j = jobs.select(F.col("id").alias("job_id"), "video_id", F.col("status").alias("job_status"))
    v = videos.select(F.col("id").alias("video_id"), F.col("status").alias("video_status"),
                      F.col("duration").alias("video_duration"), F.lit(True).alias("_vfound"))
    b = request_left_join(request_left_join(batch.select("seq", "job_id", "result", "duration"), j, "job_id"),
                          v, "video_id")
    job_ok = F.coalesce(F.col("job_status") == S.JOB_RUNNING, F.lit(False))
    found = F.coalesce(F.col("_vfound"), F.lit(False))
    eligible = job_ok & found & (F.col("video_duration") == 0) & (F.col("duration") >= 0) & \
        (F.col("video_status") == S.VIDEO_PROCESSING)
    b = _first_per_key(b, "video_id", ["seq", "job_id"], eligible)
    w = b.filter("_winner").select("video_id", F.col("duration").alias("_wdur"))
    b = join_back(b, w, "video_id", "left")
    after = F.col("_after_winner")
    vdur = F.when(after, F.col("_wdur")).otherwise(F.col("video_duration"))
    vstat = F.when(after, F.lit(S.VIDEO_PUBLISHED)).otherwise(F.col("video_status"))
    err = first_error(
        (F.col("job_status").isNull(), S.ERR_JOB_NOT_FOUND),
        (~job_ok | F.col("_winner_again"), S.ERR_JOB_CANNOT_COMPLETE),
        (~found, S.ERR_VIDEO_NOT_FOUND),
        (vdur != 0, S.ERR_DURATION_SET),
        (F.col("duration") < 0, S.ERR_DURATION_NEGATIVE),
        (vstat != S.VIDEO_PROCESSING, S.ERR_VIDEO_CANNOT_PUBLISH),
    )
    acc = F.col("_winner")
    return b.select("seq", "job_id", "video_id", acc.alias("accepted"), F.when(~acc, err).alias("error"),
                    F.when(acc, S.JOB_COMPLETED).otherwise(F.col("job_status")).alias("job_status"),
                    F.when(acc, F.col("result")).alias("job_result"),
                    F.when(acc, S.VIDEO_PUBLISHED).otherwise(F.col("video_status")).alias("video_status"),
                    F.when(acc, F.col("duration")).otherwise(F.col("video_duration")).alias("video_duration"))


def fail_jobs(batch: DataFrame, jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """X16 over (seq, job_id, error_msg): job running (X11), video found (J4), video
    processing -> failed (X4)."""
    j = jobs.select(F.col("id").alias("job_id"), "video_id", F.col("status").alias("job_status"))
    v = videos.select(F.col("id").alias("video_id"), F.col("status").alias("video_status"), F.lit(True).alias("_vfound"))
    b = request_left_join(request_left_join(batch.select("seq", "job_id", "error_msg"), j, "job_id"), v, "video_id")
    job_ok = F.coalesce(F.col("job_status") == S.JOB_RUNNING, F.lit(False))
    found = F.coalesce(F.col("_vfound"), F.lit(False))
    eligible = job_ok & found & (F.col("video_status") == S.VIDEO_PROCESSING)
    b = _first_per_key(b, "video_id", ["seq", "job_id"], eligible)
    vstat = F.when(F.col("_after_winner"), F.lit(S.VIDEO_FAILED)).otherwise(F.col("video_status"))
    err = first_error(
        (F.col("job_status").isNull(), S.ERR_JOB_NOT_FOUND),
        (~job_ok | F.col("_winner_again"), S.ERR_JOB_CANNOT_FAIL),
        (~found, S.ERR_VIDEO_NOT_FOUND),
        (vstat != S.VIDEO_PROCESSING, S.ERR_VIDEO_CANNOT_FAIL),
    )
    acc = F.col("_winner")
    return b.select("seq", "job_id", "video_id", acc.alias("accepted"), F.when(~acc, err).alias("error"),
                    F.when(acc, S.JOB_FAILED).otherwise(F.col("job_status")).alias("job_status"),
                    F.when(acc, F.col("error_msg")).alias("job_error_msg"),
                    F.when(acc, S.VIDEO_FAILED).otherwise(F.col("video_status")).alias("video_status"))


def archive_videos(requests: DataFrame, videos: DataFrame, key: str = "id") -> DataFrame:
    """Find (F1) then archive (X5), a row per request. Of repeated requests for a published
    video one is accepted; the others find it archived."""
    v = videos.select(F.col("id").alias(key), F.col("status").alias("_status"), F.lit(True).alias("_found"))
    r = request_left_join(requests.groupBy(key).agg(F.count(F.lit(1)).alias("_times")), v, key)
    r = r.withColumn("_again", F.explode(F.when(F.col("_times") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    ok = F.col("_status") == S.VIDEO_PUBLISHED
    err = first_error((F.col("_found").isNull(), S.ERR_VIDEO_NOT_FOUND),
                      (~ok | F.col("_again"), S.ERR_VIDEO_CANNOT_ARCHIVE))
    # the second row stands for all repeats: one row each
    out = r.select(F.col(key).alias("id"), err.isNull().alias("accepted"), err.alias("error"),
                   F.when(F.coalesce(ok, F.lit(False)), S.VIDEO_ARCHIVED).otherwise(F.col("_status")).alias("status"),
                   F.when(F.col("_again"), F.col("_times") - 1).otherwise(F.lit(1)).alias("_rows"))
    return out.withColumn("_rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows").cast("long")))).drop("_rows")


def set_duration(requests: DataFrame, videos: DataFrame, seq: str = "seq") -> DataFrame:
    """X7 on (id, duration[, seq]): rejected if the current duration is not 0, then if
    negative. Requests of one id are judged in ``seq`` order (distinct; without that column by
    duration), each against what the accepted ones before it left: the first positive one sets
    the duration, a zero leaves it unset."""
    order = [seq] if seq in requests.columns else ["duration"]
    v = videos.select("id", F.col("duration").alias("_cur"), F.lit(True).alias("_found"))
    r = request_left_join(requests.select("id", "duration", *[c for c in order if c != "duration"]), v, "id")
    r = _first_per_key(r, "id", order, (F.col("_cur") == 0) & (F.col("duration") > 0))
    won = join_back(r, r.filter("_winner").select("id", F.col("duration").alias("_set")).distinct(), "id", "left")
    cur = F.when(F.col("_after_winner"), F.col("_set")).otherwise(F.col("_cur"))
    err = first_error((F.col("_found").isNull(), S.ERR_VIDEO_NOT_FOUND),
                      (cur != 0, S.ERR_DURATION_SET),
                      (F.col("duration") < 0, S.ERR_DURATION_NEGATIVE))
    return won.select("id", *[c for c in order if c != "duration"], err.isNull().alias("accepted"), err.alias("error"),
                      F.when(err.isNull(), F.col("duration")).otherwise(cur).alias("duration"))


def rename_users(users: DataFrame, changes: DataFrame, now, seq: str = "seq") -> DataFrame:
    """Username update, always accepted (the last change per user wins)."""
    last = changes.groupBy("id").agg(F.max_by("username", seq).alias("_new"))
    j = join_back(users, last, "id", "left")
    return j.select("id", F.coalesce("_new", "username").alias("username"),
                    F.when(F.col("_new").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
                    .alias("updated_at"))


def upload_batch(uploads: DataFrame, now) -> DataFrame:
    """Each upload becomes a pending video (X1) and a pending transcode job (X8); any
    rule failure writes neither. Ids are derived from the upload id (repeatable)."""
    vid = F.concat(F.lit("vid-"), F.col("upload_id"))
    err = video_error(F.col("upload_id"), "filename", "resource_id")
    ok = err.isNull()
    ts = F.lit(now).cast("timestamp")
    return uploads.select(
        "upload_id", F.when(ok, vid).alias("video_id"),
        F.when(ok, F.concat(F.lit("job-"), F.col("upload_id"))).alias("job_id"),
        ok.alias("accepted"), err.alias("error"),
        F.when(ok, F.lit(S.VIDEO_PENDING)).alias("status"), F.when(ok, F.col("resource_id")).alias("resource_id"),
        "title", "description", "filename", F.when(ok, ts).alias("created_at"))


def uploaded_rows(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The videos and jobs rows an upload batch writes (accepted uploads only)."""
    a = batch.filter("accepted")
    videos = a.select(F.col("video_id").alias("id"), "title", "description", F.lit(0).cast("long").alias("duration"),
                      "filename", "resource_id", F.col("status"), "created_at", F.col("created_at").alias("updated_at"))
    jobs = a.select(F.col("job_id").alias("id"), "video_id", F.lit(S.JOB_TYPE_TRANSCODE).alias("type"),
                    F.lit(S.JOB_PENDING).alias("status"), F.lit("").alias("result"), F.lit("").alias("error_msg"),
                    "created_at", F.col("created_at").alias("updated_at"))
    return videos, jobs


def _first_on_both(rows: DataFrame, seq: str) -> DataFrame:
    """The signups accepted when rows (seq, email, username) are judged in ``seq`` order, each
    against the accepted ones before it. Rows that come first on both e-mail and username are
    accepted, their rivals go, and so on: one round per link of the longest chain of
    conflicts, one round in all where there are none."""
    accepted, rest = None, checkpoint_cut(rows)
    while True:
        r = rest.join(rest.groupBy("email").agg(F.min(seq).alias("_fe")), "email") \
            .join(rest.groupBy("username").agg(F.min(seq).alias("_fu")), "username")
        won = checkpoint_cut(r.filter((F.col("_fe") == F.col(seq)) & (F.col("_fu") == F.col(seq)))
                             .select(seq, "email", "username"))
        accepted = won if accepted is None else accepted.unionByName(won)
        rest = checkpoint_cut(rest.join(won.select("email"), "email", "left_anti")
                              .join(won.select("username"), "username", "left_anti"))
        if rest.isEmpty():
            return accepted
        if won.isEmpty():
            raise ValueError(f"signups need distinct values of {seq}, none of them null")


def signup_batch(signups: DataFrame, users: DataFrame, roles: DataFrame, role_slugs: DataFrame, now,
                 seq: str = "user_id") -> DataFrame:
    """X18 (data part): validate the user (F9), require the role (U5: unknown role rolls the
    whole signup back), reject e-mail / username already taken (UNIQUE; within the batch by a
    signup accepted before, in the order of ``seq``), then emit claims rows: permissions of the
    role (J1), access expiry now + 15 min, refresh expiry now + 7 days."""
    r = bounded_broadcast(roles.select(F.col("name").alias("role_name"), F.lit(True).alias("_role_ok")), 1_000_000)
    s = signups.join(r, "role_name", "left")
    s = with_exists_flag(with_exists_flag(s, users, "email", "_email_taken"), users, "username", "_name_taken")
    s = checkpoint_cut(s)
    alone = ~(blank("user_id") | blank("email") | blank("username") | blank("password_hash")) \
        & F.col("_email_taken").isNull() & F.col("_name_taken").isNull() & F.col("_role_ok").isNotNull()
    won = _first_on_both(s.filter(alone).select(*dict.fromkeys([seq, "email", "username"])), seq)
    s = s.join(won.select("email", F.col(seq).alias("_ae")), "email", "left") \
        .join(won.select("username", F.col(seq).alias("_au")), "username", "left")
    err = first_error(
        (blank("user_id"), S.ERR_USER_ID_EMPTY), (blank("email"), S.ERR_EMAIL_EMPTY),
        (blank("username"), S.ERR_USERNAME_EMPTY), (blank("password_hash"), S.ERR_PWD_HASH_EMPTY),
        (F.col("_email_taken").isNotNull() | (F.col("_ae") < F.col(seq)), S.ERR_EMAIL_EXISTS),
        (F.col("_name_taken").isNotNull() | (F.col("_au") < F.col(seq)), S.ERR_USERNAME_EXISTS),
        (F.col("_role_ok").isNull(), S.ERR_ROLE_NOT_FOUND),
    )
    perms = role_slugs.groupBy("role_name").agg(F.sort_array(F.collect_set("slug")).alias("_perms"))
    s = s.join(perms, "role_name", "left")
    ok = err.isNull()
    ts = F.lit(now).cast("timestamp")
    return s.select(
        "user_id", "username", "email", "role_name", ok.alias("accepted"), err.alias("error"),
        F.when(ok, F.array_join(F.coalesce("_perms", F.array().cast("array<string>")), ",")).alias("permissions"),
        F.when(ok, ts + F.expr(f"INTERVAL {S.ACCESS_TTL_MINUTES} MINUTES")).alias("access_expires_at"),
        F.when(ok, ts + F.expr(f"INTERVAL {S.REFRESH_TTL_DAYS} DAYS")).alias("refresh_expires_at"))


def login_claims(lookups: DataFrame, users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame,
                 permissions: DataFrame, now) -> DataFrame:
    """X19 (data part): found login keys (F4, first matching id) with the user's permission
    list (J2 + A2) and the token expiries. The password check is outside the data path.
    Only the logged-in users' role links are joined: user_roles is semi-joined to the batch's
    user ids first (broadcast when the batch is proven small), so a login batch never
    computes permission lists for the whole user base."""
    from .rbac import permissions_by_user
    found = lookups.filter("found").select("key_id", "user_id")
    ids = found.select("user_id").distinct()
    ur = user_roles.join(bounded_broadcast(ids, 200_000), "user_id", "left_semi")
    lists = permissions_by_user(ur, role_permissions, permissions) \
        .groupBy("user_id").agg(F.sort_array(F.collect_set("slug")).alias("_perms"))
    u = request_left_join(found, users.select(F.col("id").alias("user_id"), "username"), "user_id") \
        .filter(F.col("username").isNotNull() | F.col("user_id").isNull())
    ts = F.lit(now).cast("timestamp")
    return (join_back(u, lists, "user_id", "left")
            .select("key_id", "user_id", "username",
                    F.array_join(F.coalesce("_perms", F.array().cast("array<string>")), ",").alias("permissions"),
                    (ts + F.expr(f"INTERVAL {S.ACCESS_TTL_MINUTES} MINUTES")).alias("access_expires_at"),
                    (ts + F.expr(f"INTERVAL {S.REFRESH_TTL_DAYS} DAYS")).alias("refresh_expires_at")))


__all__ = ["Machine", "VIDEO_MACHINE", "JOB_MACHINE", "start_jobs", "complete_jobs", "fail_jobs",
           "archive_videos", "set_duration", "rename_users", "upload_batch", "uploaded_rows",
           "signup_batch", "login_claims", "user_error"]
