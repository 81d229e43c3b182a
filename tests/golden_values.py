"""Fixed values of public records for the golden tests, one entry per line, in the order of their sources."""

# Aligned GTPases KRas, NRas and HRas: UniProt P01116, P01111, P01112.
RAS = (
    "MTEYKLVVVGAGGVGKSALTIQLIQNHFVDEYDPTIEDSYRKQVVIDGETCLLDILDTAGQEEYSAMRDQYMRTGEGFLCVFAINNTKSFEDIHHYREQIKRVKDSEDVPMVLVGNKCDLPSRTVDTKQAQDLARSYGIPFIETSAKTRQRVEDAFYTLVREIRQYRL-KK-ISKEEKTPGCVKIKKCIIM",
    "MTEYKLVVVGAGGVGKSALTIQLIQNHFVDEYDPTIEDSYRKQVVIDGETCLLDILDTAGQEEYSAMRDQYMRTGEGFLCVFAINNSKSFADINLYREQIKRVKDSDDVPMVLVGNKCDLPTRTVDTKQAHELAKSYGIPFIETSAKTRQGVEDAFYTLVREIRQYRM-KKLNSSDDGTQGC-MGLPCVVM",
    "MTEYKLVVVGAGGVGKSALTIQLIQNHFVDEYDPTIEDSYRKQVVIDGETCLLDILDTAGQEEYSAMRDQYMRTGEGFLCVFAINNTKSFEDIHQYREQIKRVKDSDDVPMVLVGNKCDLAARTVESRQAQDLARSYGIPYIETSAKTRQGVEDAFYTLVREIRQHKLRKL-NPPDESGPGC-MSCKCVLS",
)

# Phage lambda, GenBank NC_001416.1: bases 37221 to 37946, which hold cI on the complement strand at 7 to 720, and the
# translation that the record gives.
LAMBDA = (
    "tgccgatcagccaaacgtctcttcaggccactgactagcgataactttccccacaacggaacaactctcattgcatgggatcattgggtactgtgggtttagtggttgtaaaaacacctg"
    "accgctatccctgatcagtttcttgaaggtaaactcatcacccccaagtctggctatgcagaaatcacctggctcaacagcctgctcagggtcaacgagaattaacattccgtcaggaaa"
    "gcttggcttggagcctgttggtgcggtcatggaattaccttcaacctcaagccagaatgcagaatcactggcttttttggttgtgcttacccatctctccgcatcacctttggtaaaggt"
    "tctaagctcaggtgagaacatccctgcctgaacatgagaaaaaacagggtactcatactcacttctaagtgacggctgcatactaaccgcttcatacatctcgtagatttctctggcgat"
    "tgaagggctaaattcttcaacgctaactttgagaatttttgcaagcaatgcggcgttataagcatttaatgcattgatgccattaaataaagcaccaacgcctgactgccccatccccat"
    "cttgtctgcgacagattcctgggataagccaagttcatttttctttttttcataaattgctttaaggcgacgtgcgtcctcaagctgctcttgtgttaatggtttcttttttgtgctcat"
    "acgtta"
)
CI = (
    "MSTKKKPLTQEQLEDARRLKAIYEKKKNELGLSQESVADKMGMGQSGVGALFNGINALNAYNAALLAKILKVSVEEFSPSIAREIYEMYEAVSMQPSLRSEYEYPVFSHVQAGMFSPELR"
    "TFTKGDAERWVSTTKKASDSAFWLEVEGNSMTAPTGSKPSFPDGMLILVDPEQAVEPGDFCIARLGGDEFTFKKLIRDSGQVFLQPLNPQYPMIPCNESCSVVGKVIASQWPEETFG"
)

# Atoms of PDB 1YCR within 4.5 angstrom of the other chain: chain, residue, x, y, z.
INTERFACE = """
A GLU25 12.075 -14.259 -5.228
A GLU25 12.414 -15.556 -7.397
A GLU25 12.439 -16.745 -6.995
A THR26 12.965 -13.355 -2.8
A THR26 14.598 -13.915 -1.009
A THR26 15.478 -14.396 -2.032
A THR26 13.804 -15.068 -0.397
A MET50 18.794 -14.502 -3.998
A MET50 19.413 -15.149 -5.246
A MET50 18.29 -15.585 -3.043
A MET50 18.786 -15.43 -1.616
A MET50 20.698 -17.337 -2.115
A LYS51 18.595 -15.443 -6.254
A LYS51 19.082 -16.054 -7.492
A LYS51 17.911 -16.421 -8.405
A LYS51 17.019 -17.491 -7.844
A LYS51 15.826 -17.759 -8.757
A LYS51 14.86 -18.758 -8.123
A LEU54 24.244 -16.672 -6.687
A LEU54 24.751 -16.78 -8.105
A LEU54 25.816 -17.334 -8.323
A LEU54 23.318 -17.85 -6.42
A LEU54 22.858 -18.137 -4.996
A LEU54 21.786 -19.217 -5.048
A LEU54 24.023 -18.574 -4.154
A LEU57 29.396 -16.144 -8.132
A LEU57 28.097 -15.141 -6.188
A LEU57 28.991 -15.465 -4.993
A LEU57 28.163 -15.504 -3.729
A GLY58 28.606 -16.903 -8.877
A GLY58 29.093 -18.105 -9.525
A GLY58 29.881 -17.738 -10.769
A GLY58 30.833 -18.418 -11.126
A ILE61 33.497 -18.858 -8.544
A ILE61 33.109 -18.151 -7.243
A ILE61 34.337 -20.069 -8.235
A ILE61 32.359 -19.041 -6.269
A MET62 33.721 -18.882 -11.572
A MET62 32.041 -21.059 -13.299
A MET62 30.444 -21.159 -14.164
A MET62 29.206 -21.058 -12.752
A TYR67 36.567 -24.197 -8.995
A TYR67 36.529 -23.987 -10.501
A TYR67 37.095 -24.922 -11.377
A TYR67 35.967 -22.837 -11.052
A TYR67 35.975 -22.623 -12.422
A LYS70 38.12 -32.769 -9.971
A GLN71 37.857 -31.604 -7.484
A GLN71 37.161 -30.259 -7.563
A GLN72 36.399 -30.056 -8.633
A GLN72 35.719 -28.784 -8.896
A GLN72 34.859 -28.192 -7.812
A GLN72 34.446 -27.045 -7.919
A GLN72 34.93 -28.851 -10.19
A GLN72 35.723 -29.443 -11.328
A GLN72 35.798 -28.544 -12.54
A GLN72 34.92 -27.711 -12.792
A HIS73 34.592 -28.958 -6.763
A HIS73 33.791 -28.456 -5.652
A HIS73 33.074 -29.604 -4.931
A HIS73 33.991 -30.572 -4.261
A HIS73 34.639 -31.664 -4.736
A VAL75 34.913 -22.964 -5.355
A PHE91 32.671 -21.477 -2.129
A VAL93 28.225 -26.606 -2.273
A VAL93 30.275 -25.513 -4.223
A VAL93 31.333 -24.544 -4.718
A VAL93 30.274 -26.792 -4.99
A LYS94 30.08 -30.892 -3.033
A LYS94 30.722 -32.253 -2.946
A LYS94 30.952 -32.844 -4.316
A LYS94 31.566 -34.209 -4.222
A HIS96 23.89 -26.617 0.839
A HIS96 24.017 -27.365 -0.457
A HIS96 24.923 -27.019 -1.434
A HIS96 23.371 -28.46 -0.919
A HIS96 24.839 -27.875 -2.44
A HIS96 23.904 -28.759 -2.151
A ILE99 27.728 -22.153 0.328
A ILE99 28.645 -23.348 0.118
A ILE99 28.032 -21.138 -0.728
A TYR100 21.898 -20.417 2.284
A TYR100 21.482 -20.044 1.004
A TYR100 20.306 -19.348 0.814
A TYR100 19.526 -19.019 1.921
A TYR100 18.367 -18.281 1.803
A TYR104 19.091 -15.175 2.84
A TYR104 17.904 -15.133 2.138
B GLU17 31.909 -31.865 -11.563
B GLU17 32.999 -31.632 -11.049
B GLU17 32.839 -32.976 -8.139
B GLU17 32.302 -32.543 -7.098
B GLU17 33.988 -32.618 -8.498
B THR18 31.948 -29.737 -12.658
B THR18 31.419 -28.661 -11.707
B THR18 31.733 -29.316 -14.107
B PHE19 32.143 -27.542 -11.625
B PHE19 31.769 -26.453 -10.742
B PHE19 32.674 -25.245 -10.916
B PHE19 32.265 -24.076 -10.062
B PHE19 32.438 -24.116 -8.685
B PHE19 31.667 -22.955 -10.628
B PHE19 32.021 -23.055 -7.889
B PHE19 31.246 -21.888 -9.839
B PHE19 31.421 -21.935 -8.468
B SER20 28.703 -25.237 -12.606
B SER20 28.652 -24.947 -14.093
B SER20 28.286 -23.593 -14.268
B LEU22 27.753 -28.274 -8.217
B LEU22 27.124 -27.006 -7.657
B LEU22 26.32 -27.064 -6.716
B LEU22 29.18 -28.412 -7.685
B LEU22 29.872 -29.738 -7.354
B LEU22 29.042 -30.916 -7.782
B LEU22 31.236 -29.774 -8.02
B TRP23 27.477 -25.871 -8.251
B TRP23 27.585 -22.055 -8.009
B TRP23 26.73 -21.178 -8.613
B TRP23 28.09 -21.382 -6.842
B TRP23 26.659 -20.002 -7.892
B TRP23 27.478 -20.101 -6.799
B TRP23 28.99 -21.731 -5.83
B TRP23 27.738 -19.177 -5.784
B TRP23 29.251 -20.809 -4.825
B TRP23 28.623 -19.548 -4.812
B LEU25 22.403 -26.295 -5.067
B LEU25 22.155 -26.9 -4.03
B LEU25 23.113 -28.401 -6.153
B LEU26 22.657 -24.998 -5.083
B LEU26 22.616 -24.202 -3.862
B LEU26 20.63 -23.223 -4.753
B LEU26 23.652 -23.069 -3.918
B LEU26 25.825 -22.01 -4.268
B LEU26 25.723 -24.177 -3.038
B PRO27 19.329 -21.458 -2.877
B PRO27 20.105 -20.538 -2.608
B PRO27 19.491 -22.646 -0.66
B PRO27 20.369 -23.774 -0.245
B PRO27 21.48 -23.661 -1.226
B GLU28 18.368 -21.373 -3.794
B GLU28 18.139 -20.187 -4.619
B GLU28 17.306 -19.049 -4.048
B GLU28 17.039 -18.062 -4.733
B GLU28 17.603 -20.61 -5.988
B GLU28 16.553 -21.693 -5.923
B GLU28 16.395 -22.434 -7.228
B GLU28 17.341 -22.426 -8.054
B GLU28 15.315 -23.043 -7.418
B ASN29 16.925 -19.172 -2.791
B ASN29 16.147 -18.147 -2.112
B ASN29 16.548 -18.261 -0.669
B ASN29 17.159 -19.284 -0.37
B ASN29 14.634 -18.393 -2.256
B ASN29 14.044 -17.784 -3.54
B ASN29 14.536 -16.773 -4.071
B ASN29 12.963 -18.387 -4.023
B ASN29 16.296 -17.351 0.139
"""

# Designed variants: name, mutations, length, cysteines, sequence.
CANDIDATES = """
NB01_KN035 WT 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB02_K29R K29R 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGRMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB03_K29H K29H 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGHMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB04_S31T S31T 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMTSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB05_S31N S31N 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMNSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB06_S32T S32T 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSTRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB07_R34K R34K 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRKCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB08_D101E D101E 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAAESFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB09_D101N D101N 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAANSFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB10_S102T S102T 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADTFEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB11_F103Y F103Y 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSYEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB12_F103W F103W 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSWEDPTCTLVTSSGAFQYWGQGTQVTVSS
NB13_E104Q E104Q 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFQDPTCTLVTSSGAFQYWGQGTQVTVSS
NB14_D105E D105E 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEEPTCTLVTSSGAFQYWGQGTQVTVSS
NB15_T107S T107S 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPSCTLVTSSGAFQYWGQGTQVTVSS
NB16_L110I L110I 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTIVTSSGAFQYWGQGTQVTVSS
NB17_V111I V111I 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLITSSGAFQYWGQGTQVTVSS
NB18_S113T S113T 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTTSGAFQYWGQGTQVTVSS
NB19_F117Y F117Y 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSFEDPTCTLVTSSGAYQYWGQGTQVTVSS
NB20_F103Y_Q118N F103Y;Q118N 130 4 TGQVQLQESGGGLVQPGGSLRLSCAASGKMSSRRCMAWFRQAPGKERERVAKLLTTSGSTYLADSVKGRFTISQNNAKSTVYLQMNSLKPEDTAMYYCAADSYEDPTCTLVTSSGAFNYWGQGTQVTVSS
"""
