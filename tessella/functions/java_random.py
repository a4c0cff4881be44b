"""The 48-bit linear congruential generator that java.util.Random documents."""


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        out = self.state >> (48 - n)
        return out - (1 << n) if out >> (n - 1) else out

    def below(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return (bound * (self.bits(31) & 0x7FFFFFFF)) >> 31
        while True:
            drawn = self.bits(31) & 0x7FFFFFFF
            out = drawn % bound
            if drawn - out + bound - 1 < 1 << 31:
                return out
