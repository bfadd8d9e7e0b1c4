"""Names that several rules and joins share."""

# Modules and the functions of theirs whose dynamic use is a sink; "" stands for functions of any module.
DANGEROUS = {
    "os": (
        "system", "popen", "popen2", "popen3", "popen4",
        "spawn", "spawnl", "spawnle", "spawnlp", "spawnlpe", "spawnv", "spawnve", "spawnvp", "spawnvpe",
        "exec", "execl", "execle", "execlp", "execlpe", "execv", "execve", "execvp", "execvpe",
    ),
    "subprocess": ("Popen", "call", "run", "check_output", "check_call", "getoutput", "getstatusoutput"),
    "builtins": ("eval", "exec", "compile", "__import__"),
    "pickle": ("loads", "load"),
    "marshal": ("loads", "load"),
    "yaml": ("load", "unsafe_load", "full_load"),
    "": ("eval", "exec", "system", "passthru", "shell_exec", "popen", "proc_open", "assert", "create_function", "unserialize"),
}

# Shells and their command flags.
SHELLS = ("sh", "bash", "zsh", "ksh", "csh", "tcsh", "env", "cmd.exe", "cmd", "powershell.exe", "powershell", "pwsh")
FLAGS = ("-c", "/c", "/k", "-Command", "-EncodedCommand")


def names_of(*modules: str) -> str:
    """The functions of some modules as the alternatives of a pattern, each once."""
    return "|".join(dict.fromkeys(f for m in modules for f in DANGEROUS[m]))


def any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"
