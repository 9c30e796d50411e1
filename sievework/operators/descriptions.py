"""What each rule looks for and what to do about it, one rule a line: id, description, advice."""

from __future__ import annotations

_TABLE = """
complexity.cognitive | Functions that branch and nest a lot. | Move nested decisions into functions of their own, or raise the threshold.
complexity.cyclomatic | Functions with many paths. | Take branches out, or put what they decide into a table.
dead-code.unused-private-method | Private methods that their file never calls. | Remove the method or call it.
design.circular-import | Files that import each other in a circle. | Put what they share into a file that imports none of them.
design.deep-relative-import | Relative imports that climb many folders. | Move the shared file closer or import it by a name.
design.large-module-concentration | One file that holds most of a repository's code. | Split it where its duties part.
design.package-bin-missing | Executables of a manifest that do not exist. | Correct the path or add the file.
design.package-bin-not-executable | Executables of a manifest that may not be executed. | Set the file's executable bit.
docs.fixture-purpose-missing | Long fixtures that do not say what they are for. | Say above the fixture what it covers.
docs.magic-threshold-without-rationale | Limits that are set without a reason. | Say beside the number why it is this one.
docs.missing-error-behavior-doc | Comments that leave out how a function fails. | Name what it throws, reports or recovers from.
docs.missing-exported-function-doc | Exported functions without a comment. | Say what callers may rely on.
docs.missing-file-overview | Files that do not say what they are for. | Begin the file with a line about its purpose.
docs.missing-interface-doc | Interfaces without a comment. | Say what the interface promises.
docs.missing-internal-function-doc | Functions without a comment. | Say what the function is for.
docs.missing-invariant-doc | Comments that leave out a contract which the code keeps. | Name the schema, order or identity that must hold.
docs.missing-param-tag | Parameters that a documentation block leaves out. | Describe every parameter.
docs.missing-public-doc | Exported classes, types and enums without documentation. | Document what is exported.
docs.missing-return-tag | Results that a documentation block leaves out. | Describe the result.
docs.missing-side-effect-doc | Comments that leave out what a function changes outside. | Name the file, process or connection that changes.
docs.missing-why-for-complex-code | Comments on complex functions that give no reason for their shape. | Say which compromise or rule makes it so.
docs.stale-comment | Comments that name files, rules, options or symbols that do not exist. | Correct the name or say that it is history.
docs.stale-param-tag | Described parameters that do not exist. | Remove the tag or correct its name.
docs.suppression-without-rationale | Checks that are switched off without a reason. | Say why the check is wrong here.
docs.todo-without-tracking | To-dos that are tracked nowhere. | Add an issue, an owner or a date.
docs.useless-docblock | Comments that only repeat a name. | Say what the name does not.
waste.any-type | The type any. | Use a type that says what the value is.
waste.broad-runtime-version | Dependencies that accept nearly any version. | Bound the range of versions.
waste.commented-out-code | Code in comments. | Remove it; the history keeps it.
waste.console-log | Lines that write to the console. | Remove them or use a logger.
waste.empty-function | Functions that do nothing. | Remove the function or say why it is empty.
waste.exported-any | Exported declarations that use any. | Give what is exported a type.
waste.redundant-boolean-cast | Conditions that are cast to a boolean. | Leave the cast out.
waste.redundant-variable | Variables that are only returned. | Return the expression.
waste.swallowed-catch | Errors that are caught and dropped. | Handle the error, pass it on, or say why it may be dropped.
waste.unreachable-code | Lines that no path leads to. | Remove them or correct the flow.
waste.unused-import | Imports that are not used. | Remove the import.
waste.unused-parameter | Parameters that are not used. | Remove the parameter or begin its name with an underscore.
waste.useless-catch | Errors that are caught only to be thrown again. | Remove the block or handle the error.
waste.useless-return | Functions that end with an empty return. | Remove the return.
modernisation.date-now-candidate | Long forms of the present time. | Use Date.now().
modernisation.double-cast | Casts by way of unknown or any. | Check the value or parse it.
modernisation.loose-equality | Comparisons that convert types. | Use === or !==.
modernisation.non-null-assertion | Null checks that are waived. | Check for null.
modernisation.nullish-coalescing-candidate | Defaults by || that replace 0, false and empty texts too. | Use ?? where only null and undefined are meant.
modernisation.object-spread-candidate | Copies by Object.assign. | Use a spread.
modernisation.optional-chaining-candidate | Properties behind a check of their object. | Use optional chaining.
modernisation.public-property | Public properties. | Use readonly or an accessor.
modernisation.readonly-property-candidate | Properties that could be readonly. | Mark them readonly.
modernisation.ts-comment-without-rationale | Type errors that are switched off without a reason. | Give the reason behind the directive.
modernisation.tsconfig-exact-optional-disabled | Compiler settings without exactOptionalPropertyTypes. | Switch it on.
modernisation.tsconfig-index-safety-disabled | Compiler settings without noUncheckedIndexedAccess. | Switch it on.
modernisation.tsconfig-strict-disabled | Compiler settings without strict. | Switch it on.
modernisation.var-declaration | Declarations by var. | Use let or const.
naming.acronym-case | One acronym in several spellings. | Choose one spelling in a file.
naming.boolean-prefix | Names of booleans that are no statement. | Begin the name with is, has, can or the like.
naming.class-file-mismatch | Exported classes in files of another name. | Give class and file one name.
naming.generic-function | Names of functions that say nothing. | Name what the function does.
naming.generic-parameter | Names of parameters that say nothing. | Name what the parameter stands for.
naming.hungarian-notation | Names that begin with their type. | Name the thing and not its type.
naming.identifier-quality | Names that are placeholders. | Name what the value stands for.
naming.inconsistent-casing | One name in several spellings. | Choose one spelling in a file.
naming.negative-boolean | Negative names of booleans. | Turn the name round.
naming.short-variable | Very short names. | Use a name that says more.
security.async-foreach | Asynchronous callbacks of forEach. | Use a loop with await or Promise.all.
security.disabled-tls-verification | Certificates that are not checked. | Check them and mend the trust store.
security.document-write | Writing to the document. | Build elements and encode what is not trusted.
security.dynamic-regexp | Regular expressions made from outside data. | Use a fixed pattern or escape the data.
security.eval-call | Code that is built at run time by eval. | Parse the data or look up what to call.
security.floating-promise | Promises that nobody waits for. | Await the promise, return it, or write void.
security.github-actions-broad-permissions | Workflows that may write. | Grant single rights to single jobs.
security.github-actions-pull-request-target | Workflows that run outside changes with rights. | Use pull_request, or keep secrets and checkouts apart.
security.github-actions-remote-shell | Steps that run what they download. | Keep the script here or check what is downloaded.
security.github-actions-secrets-in-pr | Secrets in workflows of outside changes. | Keep secrets out of them.
security.github-actions-unpinned-action | Actions that are not pinned to a commit. | Pin the action to a commit you have read.
security.inner-html | Markup that is set from code. | Build elements or sanitise the markup.
security.insecure-random | Random numbers that can be guessed. | Use the crypto module for what must not be guessed.
security.javascript-url | URLs that hold script. | Use an event handler.
security.new-function | Code that is built at run time by a constructor. | Write the function or look it up.
security.open-redirect-candidate | Redirects to where outside data says. | Redirect to known places only.
security.path-traversal-candidate | Paths made from outside data. | Resolve the path below a folder and refuse others.
security.process-exec | Processes whose arguments may come from outside. | Use fixed commands and check arguments.
security.proto-access | Access to a prototype. | Use Object.getPrototypeOf and checked keys.
security.remote-install-script | Scripts of a manifest that run what they download. | Keep the script here.
security.risky-lifecycle-script | Scripts that run at installation. | Let users call the script.
security.sql-concatenation | Statements put together from text. | Use parameters.
security.ssrf-candidate | Requests to where outside data says. | Request known hosts only.
security.string-timer | Timers that are given text. | Give them a function.
security.throw-non-error | Throwing what is no error. | Throw an Error.
security.unsafe-deserialization | Outside data that is turned into objects or code. | Parse it with a schema that allows data only.
security.url-dependency | Dependencies from URLs, repositories or folders. | Use versions of a registry.
security.weak-crypto | Broken algorithms and protocols. | Use present ones.
security.xxe-candidate | Outside XML that may pull in entities. | Switch entities off.
sensitive-data.api-key-pattern | Keys of known services. | Revoke the key and read it at run time.
sensitive-data.aws-access-key | Access key ids of a cloud. | Revoke the key and read it at run time.
sensitive-data.database-url-password | Passwords in URLs. | Read the password at run time.
sensitive-data.gcp-service-account-key | Keys of service accounts. | Revoke the key and read it at run time.
sensitive-data.hardcoded-env-value | Secret values of the environment in files. | Read them at run time.
sensitive-data.high-entropy-string | Literals that look like secrets. | Read the value at run time.
sensitive-data.jwt-token | Tokens. | Revoke the token.
sensitive-data.phi-pattern | Numbers of patients. | Remove them from the repository.
sensitive-data.pii-pattern | Numbers of persons and cards. | Remove them from the repository.
sensitive-data.private-key | Private keys. | Replace the key and keep it elsewhere.
size.file-length | Long files. | Split the file, or raise the threshold.
size.function-length | Long functions. | Take steps out into functions, or raise the threshold.
size.parameter-count | Functions with many parameters. | Pass an object, or split the function.
test-quality.conditional-logic | Assertions that depend on a condition. | Write a test for each case.
test-quality.exception-type-only | Tests that only look at the type of an error. | Look at its message or effect too.
test-quality.global-state-mutation | Tests that change global state. | Restore the state after the test.
test-quality.loop-in-test | Assertions in loops. | Use a table of cases.
test-quality.magic-number-assertion | Bare numbers in assertions. | Give the number a name.
test-quality.missing-nearby-test | Files that no test covers. | Add a test beside the file.
test-quality.mock-only-test | Tests that only look at mocks. | Look at an effect too.
test-quality.no-assertions | Tests without an assertion. | Assert what the test is for.
test-quality.no-throw-only-test | Tests that only look for the absence of errors. | Look at a result too.
test-quality.only-skip | Tests that are focused or skipped. | Remove the mark.
test-quality.setup-bloat | Tests with much setup. | Move the setup into a builder.
test-quality.sleep-in-test | Tests that wait for a time. | Wait for an event.
test-quality.snapshot-only-test | Tests that only compare snapshots. | Assert what matters too.
test-quality.trivial-assertion | Assertions that cannot fail. | Compare with what is expected.
test-quality.unused-mock | Mocks that are not used. | Remove the mock.
"""

TEXTS: dict[str, tuple[str, str]] = {}
for _line in _TABLE.strip().split("\n"):
    _id, _description, _advice = (part.strip() for part in _line.split(" | "))
    TEXTS[_id] = (_description, _advice)
