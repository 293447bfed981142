"""Fixed vocabularies of traces and comparisons."""

# Kinds of events and their operations.
OPERATIONS = {
    "file": ["open", "openat", "openat2", "access", "faccessat", "faccessat2"],
    "exec": ["execve", "execveat"],
    "cwd": ["chdir", "fchdir"],
    "spawn": ["clone", "clone3", "fork", "vfork"],
    "context": ["unshare", "setns", "chroot", "pivot_root", "mount", "umount2", "move_mount", "mount_setattr"],
    "exit": ["exit"],
}

# Change kinds in rank order and their category names.
RANKS = ["ExitStatus", "CaptureCompleteness", "InvocationContext", "SuccessToFailure", "FailedExecutionAttempt", "NewExecutable", "NewFileAccess", "RemovedExecutable", "OutcomeSetChange", "OtherObservation"]
CATEGORIES = {
    "ExitStatus": "Exit status",
    "CaptureCompleteness": "Capture completeness",
    "InitialWorkingDirectory": "Initial working directory",
    "CommandArguments": "Command arguments",
    "SelectedStartupEnvironment": "Selected startup environment",
    "ExecutionAttempt": "Execution attempt changes",
    "Executable": "Executable changes",
    "NewFileAccess": "New file access",
    "RemovedFileAccess": "Removed file access",
    "FileAccessOutcome": "File access outcome changes",
}
NOT_SELECTED = "(not selected/unknown)"
UNSET = "(unset)"

# Linux signal numbers.
SIGNALS = {
    "SIGHUP": 1, "SIGINT": 2, "SIGQUIT": 3, "SIGILL": 4, "SIGTRAP": 5, "SIGABRT": 6, "SIGBUS": 7, "SIGFPE": 8,
    "SIGKILL": 9, "SIGUSR1": 10, "SIGSEGV": 11, "SIGUSR2": 12, "SIGPIPE": 13, "SIGALRM": 14, "SIGTERM": 15,
    "SIGSTKFLT": 16, "SIGCHLD": 17, "SIGCONT": 18, "SIGSTOP": 19, "SIGTSTP": 20, "SIGTTIN": 21, "SIGTTOU": 22,
    "SIGURG": 23, "SIGXCPU": 24, "SIGXFSZ": 25, "SIGVTALRM": 26, "SIGPROF": 27, "SIGWINCH": 28, "SIGIO": 29,
    "SIGPWR": 30, "SIGSYS": 31,
}

# Linux clone flags that bear on file-system contexts, and the bits of all known ones.
CLONE_FLAGS = {
    "CLONE_VM": 0x100, "CLONE_FS": 0x200, "CLONE_FILES": 0x400, "CLONE_SIGHAND": 0x800, "CLONE_PIDFD": 0x1000,
    "CLONE_PTRACE": 0x2000, "CLONE_VFORK": 0x4000, "CLONE_PARENT": 0x8000, "CLONE_THREAD": 0x10000,
    "CLONE_NEWNS": 0x20000, "CLONE_SYSVSEM": 0x40000, "CLONE_SETTLS": 0x80000, "CLONE_PARENT_SETTID": 0x100000,
    "CLONE_CHILD_CLEARTID": 0x200000, "CLONE_DETACHED": 0x400000, "CLONE_UNTRACED": 0x800000,
    "CLONE_CHILD_SETTID": 0x1000000, "CLONE_NEWCGROUP": 0x2000000, "CLONE_NEWUTS": 0x4000000,
    "CLONE_NEWIPC": 0x8000000, "CLONE_NEWUSER": 0x10000000, "CLONE_NEWPID": 0x20000000,
    "CLONE_NEWNET": 0x40000000, "CLONE_IO": 0x80000000,
}

# Flags that only clone3 or unshare know, by the call that takes them.
CLONE3_FLAGS = {
    "CLONE_NEWTIME": 0x80, "CLONE_CLEAR_SIGHAND": 1 << 32, "CLONE_INTO_CGROUP": 1 << 33, "CLONE_AUTOREAP": 1 << 34,
    "CLONE_NNP": 1 << 35, "CLONE_PIDFD_AUTOKILL": 1 << 36, "CLONE_EMPTY_MNTNS": 1 << 37,
}
UNSHARE_FLAGS = {
    name: bit for name, bit in CLONE_FLAGS.items()
    if name in ("CLONE_VM", "CLONE_FS", "CLONE_FILES", "CLONE_SIGHAND", "CLONE_THREAD", "CLONE_NEWNS", "CLONE_SYSVSEM", "CLONE_NEWCGROUP", "CLONE_NEWUTS", "CLONE_NEWIPC", "CLONE_NEWUSER", "CLONE_NEWPID", "CLONE_NEWNET")
} | {"CLONE_NEWTIME": 0x80, "UNSHARE_EMPTY_MNTNS": 0x100000}

# Calls whose path follows a directory argument, whose return value names a path, and the place of argv.
AT_CALLS = ["openat", "openat2", "faccessat", "faccessat2", "execveat"]
RETURNS_PATH = ["open", "openat", "openat2"]
ARGV_AT = {"execve": 1, "execveat": 2}

# Warnings of a raw trace; {} is a line or task given by the rule.
PARSE_WARNINGS = {
    "malformed": "malformed line",
    "pid": "invalid process identifier",
    "replaced": "replaced unfinished call",
    "mismatch": "resumed syscall does not match line {}",
    "unmatched": "unmatched resumed call",
    "abbreviated": "abbreviated trace data; inspect raw evidence",
    "status": "unrecognized process status: {}",
    "event": "unsupported or incomplete event: {}",
    "exit": "unfinished call from line {} ended with task {} exit; consult raw evidence",
    "spawn": "task {} unfinished call from line {} predates spawn entry at line {}; consult raw evidence",
    "newline": "trace ends without newline; possible truncation",
    "end": "unfinished call at end of trace",
}
IDENTITY_WARNINGS = {
    "Unintroduced": "task {} appeared without a successful spawn",
    "Reappeared": "task {} appeared after {} exited{} without a successful spawn",
    "LiveCollision": "successful spawn assigned {} while {} was still live",
}
IDENTITY_END = "generation identity is incomplete"

# Names of detail groups and of untrusted origins.
DETAIL_FAILED = "One-sided unsuccessful file accesses (not necessarily faults)"
DETAIL_TEMPORARY = "Temporary-looking file paths (heuristic, not ignored)"
ERRNO_PATTERN = "^E[A-Z0-9_]+$"
UNTRUSTED = ["Unintroduced", "Reappeared", "LiveCollision"]
EVIDENCE_LIMIT = 3
ALWAYS_SHOWN = 5

# Texts of context warnings.
CONTEXT_REASONS = {
    "no child": "spawn result lacked a usable child task identity",
    "spawn namespace": "namespace creation leaves only the new child path context unproven",
    "spawn unknown": "clone flags did not prove whether filesystem state is shared",
    "spawn overlap": "private clone overlapped an unresolved FS transition",
    "unshare connected": "namespace change did not prove filesystem state was split",
    "unshare unknown": "unshare flags did not prove its filesystem effect",
    "unshare over fork": "unshare overlapped an unresolved private clone snapshot",
    "unshare overlap": "unshare overlapped an unresolved FS transition",
    "namespace over fork": "namespace change overlapped an unresolved private clone snapshot",
    "namespace": "namespace change leaves only the caller path context unproven",
    "root": "root or namespace operation is outside the CWD model",
    "mount": "mount namespace transition has process-wide unmodeled reach",
    "cwd over fork": "directory change overlapped an unresolved private clone snapshot",
    "cwd unknown": "successful directory change has no absolute per-syscall directory evidence",
    "cwd overlap": "directory changes overlap and their order is not proven",
    "path": "path context unresolved; last observed CWD is not a verified current path; consult raw evidence",
    "argv": "execution arguments incomplete",
}

# Texts of capture warnings.
CAPTURE_WARNINGS = {
    "read": "cannot read trace: ",
    "signal": "unrecognized target termination signal",
    "missing": "process completion not observed for PIDs: ",
    "root": "root process completion not observed; capture incomplete",
    "collector": "collector status does not confirm target completion",
    "duration": "capture duration limit exceeded (limit: %d ms)",
    "bytes": "capture trace byte limit exceeded (observed: %d bytes, limit: %d bytes)",
}

# Names of the provenance contracts.
SELECTION_RULE = "first_successful_exec_evidence_order_v1"
IDENTITY_CONTRACT = "task_generations_evidence_order_v1"

# Sentences of the text report.
UNRELIABLE = "RELIABILITY NOT ESTABLISHED: comparison cannot establish a complete, verified result."
FOLDED_NOTE = " changes folded; all changes, paths and outcome sets remain in --json, with evidence samples capped per side (first example ranks, 1-based): "
REPORT_END = "Observed changes are investigation clues, not proof of a root cause."
PATH_NOTE = "Path semantics: absolute spellings are recorded syscall/strace observations, not physical identity guarantees; relative paths stay uncertain. Older records may contain historical CWD-derived spellings; consult raw evidence."
CWD_NOTE = "  Last observed CWD (context only, not a current physical path): "

# Contradictions between saved rows, lifetimes and target provenance.
REPLAY_ERRORS = {
    "rows": [
        "saved actor generation contradicts its observed lifetime",
        "untrusted saved task lifetime lost its identity uncertainty",
        "saved child generation lacks its next introduction",
        "colliding spawn lost its saved identity uncertainty",
    ],
    "open": "saved task lifetimes without exits require a warning and reduced completeness",
    "doubtful": "saved identity limitations require a warning and reduced completeness",
    "absent": "saved root exit requires target outcome and provenance",
    "bounds": "target provenance index is out of bounds",
    "coordinates": "target provenance changed original evidence coordinates",
    "lifetime": "target provenance references another task lifetime",
    "root": "target provenance contradicts frozen root exec selection",
    "exit": "target outcome does not reference the selected lifetime exit",
}

# Categories of saved warnings by the text after their place.
TAXONOMY = {
    "cwd.path_unresolved": r"^raw/trace\.log:[0-9]+: path context unresolved;",
    "fs.context": r"^raw/trace\.log:[1-9][0-9]*: fs\.context:",
}

# Metadata fields that a change of metadata compares.
METADATA_FIELDS = {
    "InitialWorkingDirectory": ["metadata.cwd"],
    "CommandArguments": ["metadata.command"],
    "CaptureCompleteness": ["metadata.state", "metadata.completeness", "metadata.warnings"],
    "SelectedStartupEnvironment": ["metadata.environment"],
    "ExitStatus": ["metadata.exit_code", "metadata.signal", "metadata.target_exit_raw"],
}
