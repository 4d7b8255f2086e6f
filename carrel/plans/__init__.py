"""carrel.plans"""
