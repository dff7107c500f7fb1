"""symloom.plans"""
