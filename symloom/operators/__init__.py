"""symloom.operators"""
