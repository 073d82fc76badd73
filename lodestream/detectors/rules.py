"""The detectors by inventory id. Rule ids, messages, severities, savings and patterns are fixed values: a rule is what it matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.detectors.engine import (
    Detector, anywhere, bodies, first_line, in_loops, near, nested_loops, on_code_lines, on_lines, only_first, only_if, repeated, scored, several,
    topics, until_next,
)

SOL, RS, VY = (".sol",), (".rs",), (".vy", ".vyper")
_NUMBER = "8|16|24|32|40|48|56|64|72|80|88|96|104|112|120"
_STORE = r"storage\(\)\.(?:instance|persistent|temporary)\(\)\.get"
_GUARD = r"admin\.require_auth|only_admin|assert_admin|is_admin\(|require_role\s*\(\s*Role::Admin|env\.require_auth_for_admin|check_admin"
_LOOP = r"for \(|while \("


def _repeated_assignment():
    names = F.regexp_extract_all("source", F.lit(r"(\w+)\s*=\s*[^=]"), F.lit(1))
    return F.size(names) != F.size(F.array_distinct(names))


def _has(pattern: str):
    return lambda: F.col("source").rlike(pattern)


RULES: dict[str, list[Detector]] = {
    # Line rules for Solidity.
    "R08_uncached_length": [Detector("sol-003", "medium", on_lines(r"for\s*\([^)]*\.length[^)]*\)"), "Array length is not cached in loop. Cache it to save gas.", 200, SOL)],
    "R09_post_increment": [Detector("sol-004", "low", on_lines("for", r"\bi\+\+\s*([^)\s]|$)"), "Use ++i instead of i++ to save gas", 10, SOL)],
    "R10_public_not_external": [Detector("sol-005", "medium", on_lines(r"function\s+\w+\s*\([^)]*\)\s+public"), "Function is public but could be external to save gas", 300, SOL)],
    "R11_storage_reference": [Detector("sol-002", "high", on_lines(r"\b(string|bytes|uint\[\]|address\[\])\s+storage\s+\w+", lacks=("function",)), "Storage reference where memory would do", None, SOL)],
    "R16_string_operations": [
        Detector(
            "sol-010", "medium",
            on_lines(r"string\s+concat\s*\(|string\.concat\s*\(|abi\.encodePacked\s*\(.*string|string\s+\w+\s*\+?=.*(\+.*string|\".*\")|string\s+\w+\s*\+=.*string"),
            "Expensive string operation detected. Consider using bytes instead.", None, SOL,
        )
    ],
    "R17_nested_loops": [Detector("sol-011", "high", nested_loops(r"\b(for|while)\s*\("), "Nested loop detected (depth: {}). May exceed block gas limits.", None, SOL)],
    "R19_timestamp": [
        Detector(
            "sol-013", "high", on_code_lines(r"\b(?:block\.timestamp|now)\b", lacks=(r"\bemit\b",)),
            "Unsafe reliance on block.timestamp/now detected. Block timestamps are manipulable by miners, so avoid using them for critical control flow.", None, SOL,
        )
    ],
    "R20_tx_origin": [
        Detector("sol-014", "high", on_code_lines(r"\btx\.origin\b"), "Insecure tx.origin authentication detected. Use msg.sender instead of tx.origin for authorization checks.", None, SOL)
    ],
    # Line rules for Rust.
    "R26_string_concatenation": [
        Detector("rust-001", "medium", near(r"String::new\(\)", lacks=("with_capacity",), before=-1, lines=4, need="push_str"), "Inefficient string concatenation. Consider using String::with_capacity", 150, RS)
    ],
    "R27_clone": [Detector("rust-002", "high", on_lines(r"\.clone\(\)", lacks=("//",)), "Unnecessary .clone() detected. Consider using references", 500, RS)],
    "R28_vec_capacity": [Detector("rust-003", "medium", on_lines(r"Vec::new\(\)", lacks=("with_capacity",)), "Vec created without capacity. Consider using Vec::with_capacity", 600, RS)],
    "R29_storage_access": [
        Detector("soroban-001", "high", repeated(r"storage\(\)\.(?:instance|persistent|temporary)\(\)\.get\(&(\w+)\)"), "Multiple storage reads for the same key. Cache the value", 2000, RS)
    ],
    "R30_unbounded_loop": [
        Detector(
            "soroban-002", "critical",
            several(
                (on_lines("while", lacks=("//", r"while\s+\w+\s*[<>]=?\s*\d+")), "Unbounded loop detected. This can cause CPU limit exhaustion"),
                (on_lines("for", r"storage\(\)", "iter"), "Unbounded loop detected. This can cause CPU limit exhaustion"),
            ), savings=5000, endings=RS,
        )
    ],
    # Further rules for Solidity.
    "R31_return_docs": [
        Detector(
            "missing-return-docs", "info",
            near(r"function\s+\w+\s*\([^)]*\)\s*(?:public|private|internal|external|pure|view|payable|\s)*returns\s*\(", before=5, lines=None, unless=r"@returns?\s+"),
            "Function returns a value but has no @return NatSpec comment.", None, SOL,
        )
    ],
    "R33_contract_interface": [
        Detector(
            "missing-contract-interface", "warning",
            several(
                (anywhere(r"abi\.encodeWithSignature|abi\.encodeWithSelector|abi\.encodeCall"), "direct-abi-encode"),
                (anywhere(r"(?:I[A-Z]\w*)?\(\s*address\s*\("), "raw-address-cast"),
                (anywhere(r"(?m)interface\s+\w+\s*\{[^}]*\bfunction\b[^}]*\}\s*$"), "inline-interface"),
            ), endings=SOL,
        )
    ],
    "R34_abstract_visibility": [Detector("G003", "info", only_if(on_lines("public", r";\s*$", lacks=(r"\(",), named=r"(\w+);*\s*$"), r"\babstract\s+contract\b"), "public variable '{}' in an abstract contract", None, SOL)],
    "R35_payable_admin": [Detector("G006", "info", on_lines(r"function\s+\w+", "onlyOwner|onlyAdmin", lacks=("payable",), named=r"function\s+(\w+)"), "admin function '{}' could be payable", None, SOL)],
    "R39_string_compare": [
        Detector(
            "G012", "warning", anywhere(r"keccak256\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*==\s*keccak256\s*\("),
            "Use fixed bytes32 constants or hash identifiers instead of dynamic strings.", None, SOL,
        )
    ],
    "R40_self_call": [Detector("G013", "warning", anywhere(r"\bthis\.(\w+)\s*\(", 1), "Replace external `this.{}` invocation with an internal function call.", None, SOL)],
    "R43_memory_copy": [
        Detector(
            "G018", "info",
            several(
                (first_line(_LOOP, r"mstore\(", r"mload\(", " i |uint i|uint256 i"), "Memory array copy loop detected. Consider the native MCOPY opcode."),
                (first_line(_LOOP, " = ", r"\[i\]|\[j\]", "memory"), "Solidity memory array element-by-element copy loop detected."),
            ), endings=SOL,
        )
    ],
    "R44_view_state_access": [Detector("G019", "warning", first_line("view|pure", "sload|storage"), "Warning: Redundant state variable access in view function", None, SOL)],
    "R45_memory_allocation": [
        Detector(
            "G023", "warning", only_if(on_lines("new uint", r"\[\]", lacks=(r"^\s*//",)), lacks=(_LOOP + r"|do \{",)),
            "Warning: Memory array allocated with size without corresponding population loop; consider resizing to match actual usage", None, SOL,
        )
    ],
    "R48_custom_errors": [
        Detector(
            "missing-custom-errors", "medium",
            only_if(
                on_lines(r"revert\s*\(\s*[\"'][^\"']+[\"']\s*\)|\brequire\s*\(\s*[^,]+,\s*[\"'][^\"']+[\"']\s*\)", lacks=(r"^\s*(//|/\*|\*)",), named=r"(?:revert\s*\(|,)\s*[\"']([^\"']+)[\"']\s*\)"),
                lacks=(r"error\s+[A-Za-z_$][\w$]*\s*\([^)]*\)\s*;",),
            ), "Revert string \"{}\" detected. Consider using custom errors for gas efficiency.", None, SOL,
        )
    ],
    "R57_low_level_calls": [
        Detector(
            "unsafe-low-level-calls", "high",
            several(
                (anywhere(r"\.call\s*\("), "raw-call"), (anywhere(r"\.call\s*\{[^}]*\}\s*\([^;]*\);(?!\s*require)"), "unchecked-call-result"),
                (anywhere(r"\.delegatecall\s*\("), "delegatecall-usage"),
            ), endings=SOL,
        )
    ],
    "R60_downcasting": [
        Detector(
            "unsafe-integer-downcasting", "high",
            several(
                (anywhere(r"\b(?:uint\d+\(|int\d+\()\s*[a-zA-Z_]\w*\s*\)"), "explicit-narrowing-cast"), (anywhere(rf"\buint(?:{_NUMBER}|128)\s*\("), "solidity-downcast"),
                (anywhere(rf"\bint(?:{_NUMBER})\s*\("), "int-downcast"),
            ), endings=SOL,
        )
    ],
    "R61_signature_recovery": [
        Detector(
            "unsafe-signature-recovery", "high",
            several(
                (anywhere(r"\becrecover\s*\("), "ecrecover-usage"), (anywhere(r"ecrecover\s*\([^)]*\)\s*(?![^;]*\brequire\b)"), "no-malleability-check"),
                (anywhere(r"address\s+\w+\s*=\s*ecrecover\s*\([^)]*\)\s*;"), "unchecked-recovery-result"),
            ), endings=SOL,
        )
    ],
    "R63_erc20_approval": [
        Detector(
            "improper-erc20-approval", "high",
            several((anywhere(r"\.approve\([^)]*\)"), "direct-approve-overwrite"), (anywhere(r"approve\([^)]*\);(?!\s*\{)"), "unchecked-approval-return")), endings=SOL,
        )
    ],
    "R77_abi_encode": [Detector("abi-encoding-inefficiency", "medium", anywhere(r"abi\.encode\s*\("), "Detected potentially inefficient use of abi.encode", None, SOL)],
    "R126_cached_length": [
        Detector(
            "solidity-cached-length", "warning",
            on_lines(
                r"^\s*(for|while)|for \(|while \(", r"[a-zA-Z0-9_]+\.length", named=r"([a-zA-Z0-9_]+)\.length",
                not_among=r"(?:[a-zA-Z0-9_]+(?:\[\])+)\s+(?:memory|calldata)\s+([a-zA-Z0-9_]+)",
            ), "Uncached read of state variable array length '{}.length' in loop condition incurs SLOAD gas per iteration.", None, SOL,
        )
    ],
    "R131_string_variable": [
        Detector("SOL-001", "warning", on_lines("string ", "public|private|internal", r";\s*$"), "Consider replacing `string` with `bytes32` if the value is short and fixed-length.", None, SOL)
    ],
    # Further rules for Rust contracts.
    "R49_excessive_allocation": [
        Detector(
            "excessive-memory-allocation", "warning",
            several(
                (anywhere(r"\[.*?\s*;\s*([1-9][0-9]{3,})\]"), "{}"),
                (anywhere(r"(?:Vec|String|Bytes|BytesN|Map|Vec\s*<.*?>)::with_capacity\(\s*([1-9][0-9]{3,})\s*\)"), "{}"), (anywhere(r"vec!\[.*?\s*;\s*([1-9][0-9]{3,})\]"), "{}"),
            ), endings=RS,
        )
    ],
    "R50_memory_copies": [
        Detector(
            "expensive-memory-copies", "warning",
            several(
                (anywhere(r"\.clone\(\)"), "unnecessary-clone"), (anywhere(r"String::from\(\s*\w+\s*\)|\.to_string\(\)|\.into\(\)"), "string-to-string-copy"),
                (anywhere(r"\.to_vec\(\)|\.iter\(\).*\.collect\(\)"), "vec-copy"),
                (anywhere(r"fn\s+\w+\s*\([^)]*(?:&self|self|&mut self)[^)]*\)\s*->\s*\w+\s*\{[^}]*\b(?:clone|to_owned)\b"), "large-struct-copy"),
            ), endings=RS,
        )
    ],
    "R51_expensive_sload": [
        Detector(
            "expensive-sload-operations", "warning",
            several(
                (anywhere(r"\.get\s*\([^)]+\)\s*;\s*(?s:.)*?\.get\s*\("), "repeated-sload"),
                (anywhere(rf"(?:for|while)\s*[^{{]*\{{[^}}]*?(?:env\.)?{_STORE}\s*\("), "sload-in-loop"),
                (anywhere(rf"(?:env\.)?{_STORE}\s*\([^)]+\)\s*;\s*(?:\s*//[^\n]*\n)*\s*(?:env\.)?{_STORE}"), "unbatched-sload"),
            ), endings=RS,
        )
    ],
    "R59_initializers": [
        Detector(
            "unprotected-initializers", "high",
            several(
                (first_line(lacks=(r"\bfn\s+new\b", r"fn\s+\w+_init\b", r"\bfn\s+initialize\b")), "missing-constructor"),
                (first_line(r"\bfn\s+new\b|fn\s+\w+_init\b|\bfn\s+initialize\b", lacks=(r"INITIALIZED|initialized|_init\b",)), "reinitialization-vulnerability"),
                (first_line(r"\bfn\s+new\b|fn\s+\w+_init\b|\bfn\s+initialize\b", lacks=(r"(?s)(\bfn\s+new\b|fn\s+\w+_init\b|\bfn\s+initialize\b).*require_auth",)), "unprotected-initializer"),
            ), endings=RS,
        )
    ],
    "R64_access_control": [
        Detector(
            "missing-access-control", "high",
            until_next(r"fn\s+(set_admin|transfer_admin|withdraw|pause|unpause|mint|burn|upgrade)\s*\(", " fn |pub fn ", "require_auth|only_admin|assert_owner|has_role"),
            "Privileged function(s) lack access control: {}.", None, RS,
        )
    ],
    "R65_role_hierarchies": [
        Detector(
            "detect-weak-role-hierarchies", "high",
            bodies(r"fn\s+(grant_role|assign_role|set_role|add_role|promote|escalate_role|make_admin|add_admin|give_admin|grant_admin|set_admin|transfer_role)\s*\(", lacks=(_GUARD,)),
            "Weak role hierarchy detected in: {}.", None, RS,
        )
    ],
    "R66_cross_contract": [
        Detector(
            "unsafe-cross-contract-invocation", "high",
            first_line(r"invoke_contract\s*\(|Client::new\s*\(|env\.invoke\s*\(|call_contract\s*\(", lacks=(r"require_auth|verify_contract|\.unwrap_or_else|\.expect\s*\(|match\s+.*\{",)),
            "Cross-contract invocation detected without caller validation or result verification.", None, RS,
        )
    ],
    "R67_event_topics": [
        Detector("detect-excessive-event-topics", "warning", topics(r"env\.events\(\)\.publish\s*\(", 4, r"\b(?:Bytes|BytesN|String|Vec|Map)\b"), "Excessive event topics: {}.", None, RS)
    ],
    "R68_symbol_usage": [Detector("inefficient-symbol-usage", "info", repeated(r"Symbol::new\(\s*&env\s*,\s*[\"']([^\"']+)[\"']\s*\)"), "Symbol(s) constructed multiple times: {}.", None, RS)],
    "R69_inefficient_loop": [
        Detector("inefficient-loop", "warning", anywhere(r"(?s)for\s*\([^)]*\)\s*\{[^}]*?(?:env\.storage\([^)]*\)|unchecked)[^}]*\}"), "Storage access or unchecked block in a loop", None, ())
    ],
    "R70_unsafe_operations": [
        Detector(
            "detect-unsafe-operations", "warning",
            several(
                (anywhere(r"\bunsafe\s*\{"), "unsafe-block"), (anywhere(r"\bunsafe\s+fn\s+\w+"), "unsafe-function"), (anywhere(r"\.unwrap\(\)"), "unchecked-unwrap"),
                (anywhere(r"\bpanic!\s*\("), "panic-macro"), (anywhere(r"\bunreachable!\s*\("), "unreachable-macro"),
                (anywhere(r"\bstd::mem::transmute\b|\bmem::transmute\b|\btransmute\s*<"), "transmute"), (anywhere(r"\*\s*const\s+\w+|\*\s*mut\s+\w+"), "raw-pointer"),
                (anywhere(r"[^\w](?:checked_add|checked_sub|checked_mul|checked_div|saturating_add|saturating_sub|saturating_mul|wrapping_add|wrapping_sub|wrapping_mul)\("), "unchecked-arithmetic"),
                (  # once for a line, however many operators it has
                    on_lines(
                        r"\b\w+\s*(?:\+|-|\*)\s*\w+",
                        lacks=(r"\b(?:checked_add|checked_sub|checked_mul|checked_div|saturating_add|saturating_sub|saturating_mul|wrapping_add|wrapping_sub|wrapping_mul)\s*\(", r"^\s*//", r"^\s*/\*", r"^\s*use\s+", r"[\"'].*[+\-*].*[\"']"),
                    ), "unchecked-arithmetic-operator",
                ),
            ), endings=RS,
        )
    ],
    "R72_upgrade_guards": [
        Detector("missing-upgrade-guards", "high", first_line(r"fn\s+upgrade\s*\(|fn\s+update_contract\s*\(|fn\s+set_wasm\s*\(", lacks=(r"require_auth|only_admin|assert_admin",)), "Upgrade method detected without admin authorization guard.", None, RS)
    ],
    "R91_randomness": [
        Detector(
            "unsafe-randomness", "high",
            several(*[(bodies(r"\bfn\s+(\w+)", p), f"Use of `{p.replace(chr(92), '')}` as randomness source is unsafe.") for p in ("blockhash", r"block\.timestamp", "block_timestamp")]), endings=RS,
        )
    ],
    "R119_gas_lints": [
        Detector("soroban-storage-read", "medium", near(r"\.get\(", before=20, lines=40, need=r"\.get\(", more_than=2), "Function performs several storage reads - consider caching", None, RS),
        Detector(
            "soroban-map-iteration", "high", near(r"for |while ", r"\.iter\(\)|\.keys\(|\.values\(|\.entries\(|\.range\(", before=8, lines=20, need=r"Map<|Map::|: Map"),
            "Detected potentially expensive iteration over a Soroban Map", None, RS,
        ),
        Detector("soroban-event-emission", "info", near(r"env\.events\(\)\.publish\(", lines=2, unless=","), "Event emission without topics may reduce filtering capabilities", None, RS),
    ],
    "R121_contract_lints": [
        Detector(
            "soroban-contract-macro", "high",
            several(
                (first_line(lacks=("soroban_sdk",)), "Soroban contracts should import soroban_sdk"),
                (first_line(r"#\[contractimpl\]", lacks=(r"#\[contracttype\]",)), "Contract uses #[contractimpl] but missing #[contracttype]"),
                (on_lines(r"#\[contractimpl\].*#\[contractimpl\]"), "Duplicate #[contractimpl] attribute detected"),
            ), endings=RS,
        ),
        Detector("soroban-env-parameter", "medium", near("pub fn", lacks=("Env",), lines=10, need=r"\.set\(|\.put\("), "Function performs storage operations but lacks Env parameter", None, RS),
    ],
    "R122_sdk_lints": [
        Detector(
            "stellar-sdk-usage", "medium",
            several(
                (first_line("Address", lacks=("require_auth",)), "Contract uses Address type without authorization checks"),
                (first_line("BytesN", lacks=("BytesN::<",)), "BytesN used without explicit length specification"),
            ), endings=RS,
        ),
        Detector("stellar-address-validation", "high", near("Address", "fn ", lines=15, unless="require_auth|try_from_xdr"), "Function with Address parameter lacks authorization validation", None, RS),
    ],
    "R128_storage_rent": [
        Detector(
            "soroban-storage-rent", "warning",
            several(
                (only_if(on_lines(r"env\.storage\(\)\.persistent\(\)"), "(?i)nonce|counter|session|temp|ephemeral|cache"), "Ephemeral state is stored in Persistent storage instead of Temporary storage."),
                (only_if(only_first(on_lines(r"env\.storage\(\)\.instance\(\)")), lacks=("extend_ttl",)), "Soroban instance storage modified or accessed without explicit extend_ttl call."),
            ), endings=RS,
        )
    ],
    "R132_rust_plugin": [
        Detector(
            "RUST-001", "info", on_lines(r"String::from\(\"|\.to_string\(\)", lacks=(r"^\s*//",)),
            "Heap allocation detected for a string literal. Consider using `&str` if ownership is not required.", None, RS,
        ),
        Detector("RUST-002", "warning", in_loops(r"^\s*(?:for |while |loop \{)", r"\.clone\(\)", lacks=(r"^\s*//",)), ".clone() inside a loop may cause repeated heap allocations.", None, RS),
    ],
    "R133_vyper_loop": [
        Detector("VY-001", "error", on_lines(r"^\s*for ", " in ", lacks=(r"range\(",)), "Potential unbounded loop — consider using `range(len(arr), bound=MAX)`.", None, VY)
    ],
    "R136_heuristics": [
        Detector(
            "inefficient-loop", "info",
            scored([(0.4, _has(r"\b(for|while|loop)\b")), (0.4, lambda: _has(r"\b(storage|env\.storage)\b")() & _has(r"\b(for|while)\b")()), (0.2, _has(r"\.len\(\)|\.length"))], 0.6), "inefficient-loop",
        ),
        Detector("redundant-storage-write", "info", scored([(0.5, _repeated_assignment), (0.5, _has(r"\b(storage|env\.storage|self\.\w+)\b"))], 0.5), "redundant-storage-write"),
        Detector("large-data-on-chain", "info", scored([(0.4, _has(r"\bString\b|\bstring\b")), (0.3, _has("Vec<u8>|bytes")), (0.3, _has(r'"[^"]{64,}"'))], 0.7), "large-data-on-chain"),
    ],
}
