"""RV64I instructions as text, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Register names, and mnemonics by funct3 (and funct7) of each opcode.
REGISTERS = "zero ra sp gp tp t0 t1 t2 s0 s1 a0 a1 a2 a3 a4 a5 a6 a7 s2 s3 s4 s5 s6 s7 s8 s9 s10 s11 t3 t4 t5 t6".split()
BRANCH = {0: "beq", 1: "bne", 4: "blt", 5: "bge", 6: "bltu", 7: "bgeu"}
LOAD = {0: "lb", 1: "lh", 2: "lw", 3: "ld", 4: "lbu", 5: "lhu", 6: "lwu"}
STORE = {0: "sb", 1: "sh", 2: "sw", 3: "sd"}
IMMEDIATE = {0: "addi", 4: "xori", 6: "ori", 7: "andi"}
REGISTER = {(0, 0): "add", (0, 32): "sub", (1, 0): "sll", (2, 0): "slt", (3, 0): "sltu", (4, 0): "xor", (5, 0): "srl", (5, 32): "sra", (6, 0): "or", (7, 0): "and"}
CSR = {1: "csrrw", 2: "csrrs", 3: "csrrc", 5: "csrrwi", 6: "csrrsi", 7: "csrrci"}


def bits(word: Column, low: int, count: int) -> Column:
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << count) - 1))


def signed(value: Column, width: int) -> Column:
    sign = F.lit(1 << (width - 1))
    return value.bitwiseXOR(sign) - sign


def placed(word: Column, *parts: tuple[int, int, int]) -> Column:
    """The sum of bit fields (low, count, place)."""
    return sum((F.shiftleft(bits(word, low, count), place) for low, count, place in parts), F.lit(0).cast("bigint"))


def register(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, REGISTERS)), number.cast("int"))


def _named(names: dict, key: Column, unknown: str) -> Column:
    out = F.concat(F.lit(unknown), key.cast("string"))
    for k, name in names.items():
        out = F.when(key == k, F.lit(name)).otherwise(out)
    return out


def decode(inst: Column) -> Column:
    """(mnemonic, operands) of a 32-bit instruction word given as a bigint."""
    word = inst.cast("bigint")
    opcode, funct3, funct7, csr = bits(word, 0, 7), bits(word, 12, 3), bits(word, 25, 7), bits(word, 20, 12)
    rd, rs1, rs2 = (register(bits(word, k, 5)) for k in (7, 15, 20))
    immediate = signed(csr, 12)
    stored = signed(placed(word, (7, 5, 0), (25, 7, 5)), 12)
    branch = signed(placed(word, (8, 4, 1), (25, 6, 5), (7, 1, 11), (31, 1, 12)), 13)
    jump = signed(placed(word, (21, 10, 1), (20, 1, 11), (12, 8, 12), (31, 1, 20)), 21)
    shift = bits(word, 20, 6)
    show = lambda c: c.cast("string")
    listed = lambda *c: F.concat_ws(", ", *(x if isinstance(x, Column) else F.lit(x) for x in c))
    based = lambda first, offset: F.concat(first, F.lit(", "), show(offset), F.lit("("), rs1, F.lit(")"))
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    both = F.concat(show(funct3), F.lit("."), show(funct7))
    operator = F.concat(F.lit("op?"), both)
    for (three, seven), name in REGISTER.items():
        operator = F.when((funct3 == three) & (funct7 == seven), F.lit(name)).otherwise(operator)

    def made(name, operands) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(text(name).alias("mnemonic"), text(operands).alias("operands"))

    fence = F.when(bits(word, 15, 10) == 0, F.lit("sfence.vma")).otherwise(listed(rs1, rs2))
    system = F.when(F.shiftright(word, 20) == 0, made("ecall", "")).when(F.shiftright(word, 20) == 1, made("ebreak", "")).when(csr == 0x105, made("wfi", "")).when(csr == 0x120, made("sfence.vma", fence)).when(funct7 == 9, made("sfmt", "")).otherwise(made(F.when(csr == 0x302, F.lit("mret")).otherwise(F.lit("priv")), hexed(csr)))
    arithmetic = funct7 == 16
    cases = [
        (opcode == 0x37, made("lui", F.concat(rd, F.lit(", "), hexed(bits(word, 12, 20))))),
        (opcode == 0x17, made("auipc", F.concat(rd, F.lit(", "), hexed(bits(word, 12, 20))))),
        (opcode == 0x6F, made("jal", listed(rd, show(jump)))),
        (opcode == 0x67, made("jalr", based(rd, immediate))),
        (opcode == 0x63, made(_named(BRANCH, funct3, "b?"), listed(rs1, rs2, show(branch)))),
        (opcode == 0x03, made(_named(LOAD, funct3, "l?"), based(rd, immediate))),
        (opcode == 0x23, made(_named(STORE, funct3, "s?"), based(rs2, stored))),
        ((opcode == 0x13) & (funct3 == 1), made("slli", listed(rd, rs1, show(shift)))),
        ((opcode == 0x13) & (funct3 == 5), made(F.when(arithmetic, F.lit("srai")).otherwise(F.lit("srli")), listed(rd, rs1, show(shift)))),
        (opcode == 0x13, made(_named(IMMEDIATE, funct3, "op-imm?"), listed(rd, rs1, show(immediate)))),
        (opcode == 0x33, made(operator, listed(rd, rs1, rs2))),
        ((opcode == 0x1B) & (funct3 == 0), made("addiw", listed(rd, rs1, show(immediate)))),
        ((opcode == 0x1B) & (funct3 == 1), made("slliw", listed(rd, rs1, show(shift)))),
        ((opcode == 0x1B) & (funct3 == 5), made(F.when(arithmetic, F.lit("sraiw")).otherwise(F.lit("srliw")), listed(rd, rs1, show(shift)))),
        ((opcode == 0x3B) & (funct3 == 0) & (funct7 == 0), made("addw", listed(rd, rs1, rs2))),
        ((opcode == 0x3B) & (funct3 == 0) & (funct7 == 32), made("subw", listed(rd, rs1, rs2))),
        ((opcode == 0x73) & (funct3 == 0), system),
        (opcode == 0x73, made(_named(CSR, funct3, "system?"), F.concat(rd, F.lit(", "), hexed(csr), F.lit(", "), rs1))),
        ((opcode == 0x0F) & (funct3 == 0), made("fence", "")),
        ((opcode == 0x0F) & (funct3 == 1), made("fence.i", "")),
    ]
    out = F.when(*cases[0])
    for case, value in cases[1:]:
        out = out.when(case, value)
    return out.otherwise(made("unknown", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(word)), 8, "0"))))
