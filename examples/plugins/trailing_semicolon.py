"""An example rewrite rule: a model ends without a semicolon. Run with `weirflow rewrite ROOT --rules-dir examples/plugins`."""


class TrailingSemicolon:
    id = "EX-001"
    version = 1
    tier = "safe"
    description = "a semicolon at the end of a model breaks templates that wrap it"

    def analyze(self, text, tokens, schemas):
        if tokens and tokens[-1].value == ";":
            yield tokens[-1].start, tokens[-1].end, "", "semicolon at the end"


RULE = TrailingSemicolon()
