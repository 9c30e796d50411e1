"""Completion scripts for shells, made from the command line's own parser."""

from __future__ import annotations

import argparse

SHELLS = ("bash", "zsh", "fish")


def commands(parser: argparse.ArgumentParser) -> dict[str, tuple[str, list[str]]]:
    """(help, options) per command."""
    sub = next(a for a in parser._actions if isinstance(a, argparse._SubParsersAction))
    told = {c.dest: c.help or "" for c in sub._choices_actions}
    return {name: (told.get(name, ""), sorted(o for a in p._actions for o in a.option_strings if o.startswith("--"))) for name, p in sub.choices.items()}


def listing(parser: argparse.ArgumentParser) -> str:
    """The commands with what they do, one a line."""
    return "".join(f"{name:<14} {told}\n" for name, (told, _) in sorted(commands(parser).items()))


def script(parser: argparse.ArgumentParser, shell: str) -> str:
    known = commands(parser)
    if shell == "fish":
        lines = ["complete -c sievework -f"]
        for name, (told, options) in sorted(known.items()):
            lines.append(f"complete -c sievework -n __fish_use_subcommand -a {name} -d '{told}'")
            lines += [f"complete -c sievework -n '__fish_seen_subcommand_from {name}' -l {o[2:]}" for o in options]
        return "\n".join(lines) + "\n"
    cases = "\n".join(f'    {name}) words="{" ".join(options)}" ;;' for name, (_, options) in sorted(known.items()))
    head = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return f"""{head}_sievework() {{
  local words="{' '.join(sorted(known))}"
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -o default -F _sievework sievework
"""
